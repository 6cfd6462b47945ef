"""Documents to training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import decontaminate, language_id, packing, queries, simhash, toxicity
from corpuslab.llm.common import fresh, parted_by_ids, written

#: The stages learn, hash and search: no SQL says their rows, tests hold them against brute force.
ORACLE_SQL = None


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on `labels`, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = fresh("toxic_score", docs)
    scored = toxicity.score(docs, toxicity.learn(docs, labels), keep=docs.columns, name=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def language_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told: a text that is null or has no letter goes. All
    others stay, whatever their language, also where no language was learned (no labelled row
    outside the held-out fold) or one is itself named `und`."""
    added = tuple(fresh(n, docs) for n in ("lang_pred", "lang_score", "has_letters"))
    judged = language_id.predict(docs, *language_id.learn(docs), keep=docs.columns, added=added)
    return judged.where(F.col(added[2])).select(*docs.columns)


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id: fingerprints of 3-word
    shingles link at two bits, as in op8. Of repeated rows of that id the one whose text comes first. Rows
    without an id stand for themselves only. Columns of any type and name are carried along."""
    groups = simhash.near_duplicates(docs).where("doc_id is not null")
    special, stays = fresh("special_id", docs), fresh("stays", docs)
    removed = written(
        groups.groupBy(F.col("doc_id").alias(special)).agg(
            F.count(F.lit(1)).alias("copies"), F.max(F.col("doc_id") == F.col("component_id")).alias(stays)
        ).where(f"copies > 1 or not {stays}").drop("copies"), "simhash-special",
    )
    others, concerned = parted_by_ids(docs, removed.select(F.col(special).alias("doc_id")), "doc_id")
    columns = [c for c in docs.columns if c not in ("doc_id", "text")]
    in_order = [F.to_json(F.struct(c)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c) for c in columns]
    best = (
        concerned.join(removed, F.col("doc_id") == F.col(special), "left").where(F.col(special).isNull() | F.col(stays))
        .groupBy("doc_id").agg(F.min_by(F.struct("text", *columns), F.struct("text", *in_order)).alias("row"))
    )
    fields = [F.col("doc_id") if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns]
    return others.unionByName(best.select(*fields))


def benchmark_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of `benchmark`. A row without an id cannot be named, and stays."""
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = written(judged.where("contaminated").select("doc_id").distinct(), "benchmark-hits")
    others, concerned = parted_by_ids(docs, hit, "doc_id")
    return others.unionByName(concerned.join(hit, "doc_id", "left_anti"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    return packing.pack_documents(docs, queries.vocabulary("word_bpe_49k.json"), 4096, 1)


STAGES = [
    ("toxicity", toxic_removed),
    ("language", language_known),
    ("simhash", near_copies_removed),
    ("benchmark", benchmark_removed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
