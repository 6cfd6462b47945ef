"""Line-based sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.functions.text import strip


def file_order(path: Column) -> list[Column]:
    """Folder, then the first number of the file name by value, then the name."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    name = F.element_at(F.split(path, "/"), -1)
    number = F.ltrim(F.regexp_extract(name, "[0-9]+", 0), F.lit("0"))
    return [folder, F.regexp_extract(name, "^[^0-9]*", 0), F.length(number), number, name]


def read_indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """idx, line: lines numbered from 0 in file order, over one file or a folder of parts.

    Rows of one input split have consecutive ids, so a row's number is its distance from the
    first row of its split plus the rows of earlier splits. Only the list of splits is sorted.
    Parts go by folder, then by the numbers in their names, so part 100000 follows part 99999.
    """
    raw = spark.read.text(path).select(
        "value", F.monotonically_increasing_id().alias("_id"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )
    splits = raw.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    earlier = Window.orderBy(*file_order(F.col("_file")), "_start").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    offsets = splits.withColumn("_offset", F.sum("_n").over(earlier) - F.col("_n"))
    return raw.join(offsets, ["_file", "_start"]).select(
        (F.col("_id") - F.col("_first") + F.col("_offset")).alias("idx"),
        strip(F.col("value")).alias("line"),
    )


def read_pairs(spark: SparkSession, path1: str, path2: str, split: str) -> DataFrame:
    """Two line-aligned files as split, idx, key1, key2."""
    one = read_indexed_lines(spark, path1).withColumnRenamed("line", "key1")
    two = read_indexed_lines(spark, path2).withColumnRenamed("line", "key2")
    return one.join(two, "idx").select(F.lit(split).alias("split"), "idx", "key1", "key2")


def split_of(path: Column, splits: tuple[str, ...] = ("train", "valid", "test")) -> Column:
    """Split whose name occurs in the file name."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(None).cast("string")
    for s in reversed(splits):
        out = F.when(F.contains(name, F.lit(s)), s).otherwise(out)
    return out


def read_by_split(spark: SparkSession, path: str) -> DataFrame:
    """split, line over all files of a folder."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return lines.select(
        split_of(F.col("_metadata.file_path")).alias("split"), F.col("value").alias("line")
    )


def alignment_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys are on the left only, on the right only, on both sides."""
    l = left.select(*keys).distinct().withColumn("_l", F.lit(1))  # noqa: E741
    r = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    has_l, has_r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return l.join(r, keys, "full_outer").agg(
        F.count_if(has_l & ~has_r).alias("left_only"),
        F.count_if(~has_l & has_r).alias("right_only"),
        F.count_if(has_l & has_r).alias("both"),
    ).withColumn("aligned", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def require_aligned(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Fail on any one-sided row."""
    row = alignment_report(left, right, keys).first()
    if not row.aligned:
        raise ValueError(f"{row.left_only} rows on the left only, {row.right_only} on the right only")


def write_lines(df: DataFrame, text: str, order: list[str], path: str) -> None:
    """One text per line, in order over the part files (a range partitioned sort).

    A text with a line break would come back as two lines and shift all that follow: it fails.
    """
    one_line = F.when(~F.col(text).rlike("[\\r\\n]"), F.col(text)).when(F.col(text).isNull(), F.lit(None))
    checked = one_line.otherwise(F.raise_error(F.lit(f"{text} holds a line break")).cast("string"))
    df.select(*order, checked.alias("value")).orderBy(*order).select("value").write.text(path)


def read_keywords(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """lang, word from a file with one word per line."""
    return spark.read.text(path).select(
        F.lit(lang).alias("lang"), strip(F.col("value")).alias("word")
    ).filter(F.col("word") != "")


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """run, epoch, train_loss, valid_loss from `<run>/message.log` files below a folder.

    A log is written by one process and has a line per epoch; lines are numbered in their file.
    """
    from corpuslab.operators.runs import parse_log_lines

    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"),
    )
    order = Window.partitionBy("run").orderBy("_start", "_id")
    numbered = raw.withColumn("epoch", F.row_number().over(order).cast("bigint"))
    return parse_log_lines(numbered.drop("_start", "_id"))


def golden_blocks(files: DataFrame, content: str = "value") -> DataFrame:
    """Blocks `==== name ==== code --- tree` of whole-file texts, in order."""
    pattern = r"(?s)={3,}[ \t]*\n([^\n]*)\n={3,}[ \t]*\n(.*?)\n---+[ \t]*\n(.*?)(?=\n={3,}[ \t]*\n[^\n]*\n={3,}|\z)"
    keep = [c for c in files.columns if c != content]
    # a block is found once; its parts are what stands before and behind its first two marks
    top, line = r"^={3,}[ \t]*\n([^\n]*)\n={3,}[ \t]*\n", r"(?s)^(.*?)\n---+[ \t]*\n"
    blocks = files.select(*keep, F.posexplode(F.regexp_extract_all(F.col(content), F.lit(pattern), 0)).alias("block_no", "block"))
    heads = blocks.select(*keep, "block_no", "block", F.regexp_extract("block", top, 0).alias("head"))
    bodies = heads.select(*keep, "block_no", "head", F.expr("substring(block, length(head) + 1)").alias("body"))
    return bodies.select(
        *keep, F.col("block_no").cast("bigint").alias("block_no"), strip(F.regexp_extract("head", top, 1)).alias("name"),
        strip(F.regexp_extract("body", line, 1)).alias("code"),
        strip(F.col("body").substr(F.length(F.regexp_extract("body", line, 0)) + 1, F.length("body"))).alias("tree"),
    )


def read_golden_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return golden_blocks(files.select(F.col("_metadata.file_path").alias("file"), "value"))
