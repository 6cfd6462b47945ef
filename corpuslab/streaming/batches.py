"""What micro-batches leave behind: mergeable rows in a bounded number of folders.

Each batch writes a folder of its own. When several have gathered, all before the current one are merged into
one, named after the last batch in it, and only then deleted. A reader takes the latest merged folder and the
batches after it, so it counts each batch once wherever a writer was stopped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Batches that are left apart before they are merged.
APART = 8

_NAME = re.compile(r"(batch|until)-(\d+)$")


def _folders(spark: SparkSession, path: str) -> tuple[object, dict[str, list[int]]]:
    """The file system, and the numbers of complete folders of both kinds."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"batch": [], "until": []}
    if files.exists(root):
        for status in files.listStatus(root):
            name = _NAME.search(status.getPath().getName())
            if name and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[name[1]].append(int(name[2]))
    return files, found


def _current(found: dict[str, list[int]]) -> tuple[int, list[int]]:
    """The last merged batch (-1 for none) and the batches after it."""
    base = max(found["until"], default=-1)
    return base, sorted(b for b in found["batch"] if b > base)


def _paths(path: str, base: int, batches: list[int]) -> list[str]:
    return ([f"{path}/until-{base}"] if base >= 0 else []) + [f"{path}/batch-{b}" for b in batches]


def write_batch(rows: DataFrame, path: str, batch_id: int, merge: Callable[[DataFrame], DataFrame], apart: int = APART) -> None:
    """Writes a batch's rows, in place of what an earlier try of it left, and merges older batches if there are
    `apart` of them. `merge` turns rows of several batches into rows of one."""
    spark = rows.sparkSession
    files, found = _folders(spark, path)
    base, _ = _current(found)
    if batch_id <= base:
        return  # has been merged: the batch was complete before a later one began
    merge(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
    older = [b for b in _current(found)[1] if b < batch_id]
    if len(older) < apart:
        return
    merged = merge(spark.read.schema(rows.schema).parquet(*_paths(path, base, older)))
    merged.coalesce(1).write.mode("overwrite").parquet(f"{path}/until-{older[-1]}")
    for gone in [f"until-{b}" for b in found["until"]] + [f"batch-{b}" for b in found["batch"] if b <= older[-1]]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{gone}"), True)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches so far; those of merged batches are together."""
    return spark.read.parquet(*_paths(path, *_current(_folders(spark, path)[1])))
