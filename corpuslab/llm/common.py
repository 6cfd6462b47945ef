"""What several operators share: Arrow maps, written tables, and connected components."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import cut_lineage, scratch_path

#: Texts in one slice of a batch together have about this many characters at most (a longer text
#: is a slice of its own), which bounds what a Python worker holds at once.
SLICE_CHARS = 1_000_000


def row_map(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Maps column lists to column lists, slice by slice, in Arrow.

    `make` runs once a task and returns the function of a slice: {column: list} to
    {column: list or array} in the order of `schema`. No column of `df` may be named `text`
    unless it is the text by which slices are cut.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = [f.name for f in arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            fn = make()
            for batch in batches:
                for part in _slices(batch):
                    out = fn(part.to_pydict())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[n], type=arrow.field(n).type) for n in names], names=names
                    )
        finally:
            fn = None
            let_go()

    return df.mapInArrow(run, schema)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What a worker process keeps from task to task, made once. One thing only: when the next
    operator comes, what the last one learned is given up, so memory does not add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


#: Megabytes that a worker may hold between tasks. Spark keeps idle workers, several to an executor.
HELD_MB = 140


def let_go() -> None:
    """At a task's end: a worker that holds much gives up what it kept, and returns the memory."""
    try:
        with open("/proc/self/statm") as f:
            held = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    except OSError:  # no such file on this system
        held = HELD_MB + 1
    if held > HELD_MB:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if "text" not in batch.schema.names or batch.nbytes <= SLICE_CHARS:
        if batch.num_rows:
            yield batch
        return
    start, size = 0, 0
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: computed once, and safe when executors go."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of an id filter at most: 2**26 are eight megabytes, however many ids there are.
MOST_BITS = 26


def parted_by_ids(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is certainly not in `ids`, all others), told by a filter of bounded size.

    So only rows that may be concerned have to meet `ids` in a join, and whole texts of the others
    are not shuffled. Rows with a null id are with the first. With very many ids the filter lets
    more rows through to the join, never fewer.
    """
    known = ids.select(F.xxhash64(F.col(column)).alias("h")).where(F.col(column).isNotNull())
    bits = min(MOST_BITS, max(10, known.count().bit_length() + 5))
    place = F.shiftrightunsigned("h", 64 - bits)
    one = F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(h, {64 - bits}), 64) as int))")
    words = known.select(F.shiftright(place, 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    filled = np.zeros(1 << (bits - 6), dtype=np.int64)
    filled[words.column("w").to_numpy()] = words.column("b").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    @F.pandas_udf("boolean")
    def may_be(h: pd.Series) -> pd.Series:
        at = h.to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        return pd.Series((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))

    concerned = may_be(F.xxhash64(F.col(column)))
    return rows.where(F.col(column).isNull() | ~concerned), rows.where(F.col(column).isNotNull() & concerned)


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of an id's text, modulo `folds`; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node that has an edge: columns `node`, `root`.

    Alternates two star steps until nothing changes: every node hangs its larger neighbours under
    its smallest neighbour, then its smaller ones. The number of rounds is logarithmic in the
    longest path. Minima are combined before they are shuffled, and edges meet them in plain
    joins, whose large partitions Spark splits; no node's neighbours are gathered.
    Nulls, loops and repeated edges are ignored; an empty table gives an empty one.
    """
    pairs = (
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("lo") < F.col("hi")))
        .distinct()
    )
    pairs = cut_lineage(pairs)
    state = None
    while True:
        both = pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionAll(
            pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m"))
        )
        least = both.groupBy("n").agg(F.min("m").alias("top"))
        large = (
            pairs.join(least, F.col("lo") == F.col("n"))
            .select(F.least("top", "lo").alias("lo"), "hi").distinct()
        )
        low = large.groupBy("hi").agg(F.min("lo").alias("top")).withColumnRenamed("hi", "n")
        small = (
            large.join(low, F.col("hi") == F.col("n"))
            .select(F.explode(F.array(
                F.struct(F.col("top").alias("lo"), F.col("hi").alias("hi")),
                F.struct(F.col("top").alias("lo"), F.col("lo").alias("hi")),
            )).alias("e"))
            .select("e.lo", "e.hi").where(F.col("lo") < F.col("hi")).distinct()
        )
        pairs = cut_lineage(small)
        seen = pairs.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")),
        ).first()
        if seen == state:
            break
        state = seen
    stars = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionAll(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
