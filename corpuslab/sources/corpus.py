"""Structured sources and sinks: JSON corpora, token records, predictions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuslab.operators.columns import firsts
from corpuslab.session import cut_lineage

MATRIX = T.ArrayType(T.ArrayType(T.StringType()))


def corpus_schema(key1: str, key2: str, with_idx: bool = True) -> T.StructType:
    fields = [T.StructField("idx", T.LongType())] if with_idx else []
    fields += [T.StructField(k, T.StringType()) for k in (key1, key2)]
    fields += [T.StructField(f"{k}_t", MATRIX) for k in (key1, key2)]
    return T.StructType(fields)


def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines: unlike one large array it can be split on reading."""
    df.write.json(path)


def read_json(spark: SparkSession, path: str, key1: str, key2: str, array: bool = False) -> DataFrame:
    """Corpus objects; `array` reads the old layout of one array per file."""
    schema = corpus_schema(key1, key2)
    return read_array(spark, path, schema) if array else spark.read.schema(schema).json(path)


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of files that each hold one JSON array, read by as many tasks as a file has byte ranges.

    Files are cut at closing braces. Whether a piece starts inside a string (quotes so far) and how deep it lies
    (braces outside strings) is what the pieces of its byte range before it add up to, and the ranges before. A
    first reading sums up ranges, for either start; only those sums are walked for a whole file. Then each range
    puts its objects together where it is read, and only what stands before its first and behind its last
    end of an object meets that of other ranges. Objects that do not parse give nulls.
    """
    def raw() -> DataFrame:
        return spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("piece"))

    sums = raw().mapInArrow(_range_sums, "file string, range bigint, quotes bigint, plain bigint, quoted bigint")
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2
    starts = sums.withColumn("inside", inside).withColumn("net", F.when(F.col("inside") == 0, F.col("plain")).otherwise(F.col("quoted"))).select(
        "file", "range", "inside", F.coalesce(F.sum("net").over(earlier), F.lit(0)).cast("bigint").alias("deep"))
    starts = cut_lineage(starts)  # one row for each byte range

    def parts(whole: bool) -> DataFrame:
        # which part of a range: 0 up to its first end of an object, 1 between ends, 2 behind the last one
        started = raw().join(F.broadcast(starts), ["file", "range"], "left").select("file", "range", "piece", "inside", "deep")
        return started.mapInArrow(lambda batches: _range_objects(batches, whole),
                                  "file string, range bigint, part int, text string, opens bigint, ended boolean")

    in_order = Window.partitionBy("file").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum(F.col("ended").cast("int")).over(in_order), F.lit(0))
    texts = F.sort_array(F.collect_list(F.struct("range", "part", "text")))
    met = parts(False).withColumn("number", ended).groupBy("file", "number").agg(
        F.array_join(F.transform(texts, lambda p: p["text"]), "}").alias("text"), F.sum("opens").alias("opens"))
    objects = parts(True).select("text", "opens").unionByName(met.select("text", "opens"))
    found = objects.where("opens > 0").select(F.concat(F.regexp_replace("text", r"(?s)^[^{]*", ""), F.lit("}")).alias("text"))
    return found.select(F.from_json("text", schema).alias("o")).select("o.*")


def _counted(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotes of pieces, and braces opened outside strings by those that start outside and inside of one."""
    bare = pc.replace_substring_regex(pieces, r"(?s)\\.", "")

    def opened(texts: pa.Array) -> np.ndarray:
        return np.asarray(pc.count_substring(pc.replace_substring_regex(texts, r'"[^"]*("|\z)', ""), "{"), np.int64)

    return (np.asarray(pc.count_substring(bare, '"'), np.int64), opened(bare),
            opened(pc.replace_substring_regex(bare, r'^[^"]*("|\z)', "", max_replacements=1)))


def _steps(batch: pa.RecordBatch, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces that follow each other: braces that each opens, whether its own brace closes, and quotes so far."""
    quotes, plain, quoted = _counted(batch.column("piece"))
    after = inside + np.cumsum(quotes)
    return np.where((after - quotes) % 2 == 0, plain, quoted), after % 2 == 0, after


def _of_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches that each lie in one byte range, and whether it is another range than the one before."""
    last = None
    for batch in batches:
        files, at = batch.column("file"), np.asarray(batch.column("range"))
        codes = np.asarray(files.dictionary_encode().indices)
        cuts = np.flatnonzero(firsts(codes, at)).tolist()
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            here = (files[a].as_py(), int(at[a]))
            yield batch.slice(a, b - a), here != last
            last = here


def _range_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "range", "quotes", "plain", "quoted"]
    sums: dict[tuple, list[int]] = {}
    for batch, _ in _of_ranges(batches):
        held = sums.setdefault((batch.column("file")[0].as_py(), batch.column("range")[0].as_py()), [0, 0, 0])
        quotes = 0
        for start in (0, 1):
            opens, closes, after = _steps(batch, held[0] + start)
            held[1 + start] += int(opens.sum() - closes.sum())
            quotes = int(after[-1]) - start
        held[0] = quotes
    rows = [[*where, *held] for where, held in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.string()) for i in range(5)], names=names)


def _range_objects(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Objects that lie between two ends within a range (`whole`), or what stands before its first and behind its last end."""
    def made(where: tuple, part: int, texts: pa.Array, opens: np.ndarray, ended: bool) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([where[0]] * n, pa.string()), pa.array([where[1]] * n, pa.int64()), pa.array([part] * n, pa.int32()),
             texts.cast(pa.string()), pa.array(opens, pa.int64()), pa.array([ended] * n, pa.bool_())],
            names=["file", "range", "part", "text", "opens", "ended"])

    def text(pieces: list[pa.Array]) -> pa.Array:
        return pa.array(["}".join(x for p in pieces for x in p.to_pylist())], pa.string())

    where, quotes, deep, seen, open_pieces, opened = (None, 0), 0, 0, False, [], 0
    for batch, new in _of_ranges(batches):
        if new:
            if open_pieces and not whole:
                yield made(where, 2, text(open_pieces), [opened], False)
            where = (batch.column("file")[0].as_py(), batch.column("range")[0].as_py())
            quotes, deep = batch.column("inside")[0].as_py(), batch.column("deep")[0].as_py()
            if quotes is None:
                raise ValueError("byte ranges of the files have changed since their sums were taken")
            seen, open_pieces, opened = False, [], 0
        pieces = batch.column("piece")
        opens, closes, after = _steps(batch, quotes)
        level = deep + np.cumsum(opens - closes)
        quotes, deep = int(after[-1]), int(level[-1])
        ends = np.flatnonzero(closes & (level == 0)) + 1
        total = np.append(0, np.cumsum(opens))
        if not len(ends):
            open_pieces.append(pieces)
            opened += int(total[-1])
            continue
        first, last = int(ends[0]), int(ends[-1])
        if whole == seen:  # what is open up to here ends with the first one
            yield made(where, int(seen), text([*open_pieces, pieces.slice(0, first)]), [opened + int(total[first])], True)
        if whole and len(ends) > 1:
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)
            yield made(where, 1, pc.binary_join(lists, "}"), total[ends[1:]] - total[ends[:-1]], True)
        seen, open_pieces, opened = True, [pieces.slice(last)] if last < len(pieces) else [], int(total[-1] - total[last])
    if open_pieces and not whole:
        yield made(where, 2, text(open_pieces), [opened], False)


def complete_records(df: DataFrame, key1: str, key2: str) -> DataFrame:
    """Records with tokens on both sides."""
    return df.filter((F.size(key1) > 0) & (F.size(key2) > 0))


def write_records(df: DataFrame, key1: str, key2: str, path: str, by_split: bool = True) -> None:
    writer = complete_records(df, key1, key2).write
    (writer.partitionBy("split") if by_split else writer).parquet(path)


def append_predictions(preds: DataFrame, path: str) -> None:
    """Append a batch of predictions; `model` and `batch` columns show what a rerun adds."""
    preds.write.mode("append").partitionBy("model").parquet(path)


def duplicate_predictions(preds: DataFrame) -> DataFrame:
    """Segments that were written more than once."""
    return preds.groupBy("model", "idx").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
