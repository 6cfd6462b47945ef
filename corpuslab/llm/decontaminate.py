"""Benchmark decontamination by winnowing.

A fingerprint is the smallest of `SPAN - GRAM + 1` consecutive word-`GRAM` hashes, so any `SPAN`
words shared by a document and an item give both the same fingerprint at the same place. Equal
fingerprints are joined, and each hit is extended word by word on either side: what it then covers
with `SPAN` words or more is shared text. Items shorter than `SPAN` words are looked up whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import row_map, written

SPAN, GRAM = 10, 5
STEP = SPAN - GRAM
#: Bits of the filter by which documents drop most fingerprints that no item has: 2**23 bits are
#: one megabyte, whatever the size of the benchmark.
FILTER_BITS = 23
#: ASCII that is neither a digit nor a letter parts words; A-Z are lower-cased.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)
HITS = "array<struct<kind:int,hash:long,pos:long,before:array<string>,after:array<string>>>"
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORDS).split() if text else []


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of `n` words from the hashes of the words."""
    size = max(0, len(h) - n + 1)
    out = np.full(size, n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ h[i:i + size]) * MIX
        out ^= out >> np.uint64(29)
    return out


def _selected(grams: np.ndarray) -> np.ndarray:
    """Positions that hold the smallest hash of some window, the rightmost of equal ones."""
    count = len(grams) - STEP
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = grams[:count].copy(), np.arange(count)
    for i in range(1, STEP + 1):
        less = grams[i:i + count] <= best
        best[less] = grams[i:i + count][less]
        at[less] = np.flatnonzero(less) + i
    return np.unique(at)


def _search(words: list[bytes], lengths: list[int], keep) -> list[dict]:
    """The fingerprints of one text, and its runs of each of `lengths` words, that `keep` lets pass."""
    from xxhash import xxh64_intdigest

    if len(words) < min([SPAN, *lengths]):
        return []
    h = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    found = []
    if len(words) >= SPAN:
        grams = _grams(h, GRAM)
        at = _selected(grams)
        at = at[keep(grams[at])]
        for p, g in zip(at.tolist(), grams[at].view(np.int64).tolist()):
            before, after = words[max(0, p - STEP):p][::-1], words[p:p + SPAN]
            found.append({"kind": 0, "hash": g, "pos": p, "before": [w.decode() for w in before],
                          "after": [w.decode() for w in after]})
    for n in lengths:
        grams = _grams(h, n)
        at = np.flatnonzero(keep(grams))
        for p, g in zip(at.tolist(), grams[at].view(np.int64).tolist()):
            found.append({"kind": n, "hash": g, "pos": p, "before": [],
                          "after": [w.decode() for w in words[p:p + n]]})
    return found


def fingerprint_rows(table: DataFrame, key: str, text: str, lengths: list[int] | None, bits=None) -> DataFrame:
    """`row` (tells rows apart), `key`, `n_words`, `hits`. `lengths` None: each text shorter than `SPAN` words is
    one run of its own length. `bits`: broadcast filter; hashes that it lacks are dropped."""

    def make():
        table_bits = bits.value if bits is not None else None

        def keep(g):
            if table_bits is None:
                return np.ones(len(g), dtype=bool)
            at = g >> np.uint64(64 - FILTER_BITS)
            return (table_bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

        def run(cols):
            counts, hits = [], []
            for t in cols["text"]:
                words = words_of(t)
                counts.append(len(words))
                own = [len(words)] if lengths is None and 0 < len(words) < SPAN else lengths or []
                hits.append(_search(words, own, keep))
            return {"row": cols["row"], "key": cols["key"], "n_words": counts, "hits": hits}

        return run

    return row_map(
        table.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"),
                     F.col(text).alias("text")), make,
        f"row long, key long, n_words long, hits {HITS}",
    )


def filter_words(items: DataFrame) -> np.ndarray:
    """The filter's words, one bit for each hash: at most 2**(FILTER_BITS - 6) rows reach the driver."""
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    rows = (
        items.select(F.shiftright(place, 6).alias("w"),
                     F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(hash, %d), 64) as int))" % (64 - FILTER_BITS)).alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    )
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for w, b in rows:
        out[w] = b
    return out.view(np.uint64)


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    miss = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(miss == 0, F.least(F.size(a), F.size(b))).otherwise(miss - 1).cast("long")


def shared_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(`row`, `doc_id`, `n_words` of each document row; `row`, `item_id`, `first`, `past` of its
    shared spans, which are word positions and may overlap)."""
    spark = docs.sparkSession
    rows = fingerprint_rows(items, item_id, item_text, None)
    own = written(
        rows.where("key is not null").select(F.col("key").alias("item_id"), F.inline("hits")).drop("pos").distinct(),
        "winnow-items",
    )
    short = sorted(r[0] for r in own.where("kind > 0").select("kind").distinct().collect())  # below SPAN
    bits = spark.sparkContext.broadcast(filter_words(own))
    found = written(fingerprint_rows(docs, doc_id, doc_text, short, bits), "winnow-documents")
    hits = found.select("row", F.inline("hits"))
    item = own.select("kind", "hash", "item_id", F.col("before").alias("i_before"), F.col("after").alias("i_after"))
    left, right = _common(F.col("before"), F.col("i_before")), _common(F.col("after"), F.col("i_after"))
    spans = (
        hits.join(item, ["kind", "hash"])
        .select("row", "item_id", "kind", "pos", left.alias("l"), right.alias("r"))
        .where(F.when(F.col("kind") > 0, F.col("r") == F.col("kind"))
               .otherwise((F.col("r") >= GRAM) & (F.col("l") + F.col("r") >= SPAN)))
        .select("row", "item_id", (F.col("pos") - F.col("l")).alias("first"), (F.col("pos") + F.col("r")).alias("past"))
    )
    return found.select("row", F.col("key").alias("doc_id"), "n_words"), written(spans, "winnow-spans")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: `doc_id`, `n_words`, `n_hit` (words inside shared spans),
    `n_items`, `items_sha256` (of the item ids, sorted as strings, comma-joined), `contaminated`.

    Null and empty texts have no words and are clean; items without words or id never occur.
    Repeated documents are judged each; repeated items count once. No items: all are clean; no
    documents: no rows. Texts are worked on whole.
    """
    rows, spans = shared_spans(docs, items, doc_id, doc_text, item_id, item_text)
    words = (
        spans.select("row", "first", "past").distinct()
        .select("row", F.explode(F.sequence("first", F.col("past") - 1)).alias("w")).distinct()
        .groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    met = (
        spans.select("row", F.col("item_id").cast("string").alias("item_id")).distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    )
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(words, "row", "left").join(met, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
