"""Packing of token sequences by bin completion.

Documents become pieces of at most `capacity` tokens. How many pieces there are of each length (a
table of at most `capacity` rows) is all that the search needs: it takes the largest length left,
enumerates undominated fillings of the space beside it, uses a filling as often as the counts
allow, and branches over fillings depth first. A branch is cut when the sequences used so far plus
the bound on the rest (no waste at all, or one sequence for each piece over half) reach the best
solution known; best-fit solutions are the first incumbents. The search stops at the lower bound
or after `NODES` fillings tried. Spark then numbers the pieces of each length and reads off
sequence and offset, so pieces never leave the executors.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import row_map, written
from corpuslab.llm.word_ids import encoder
from corpuslab.operators.ranks import rank_within

#: Fillings that the search may try in all, and at one place.
NODES, BRANCHES = 3_000, 6
#: Pieces of one length are numbered in lots of about this many.
LOT = 2_000


def _place(counts: np.ndarray, space: int) -> np.ndarray:
    """For each size up to `space`: the largest length left that is not larger (0: none)."""
    size = np.arange(space + 1)
    return np.maximum.accumulate(np.where(counts[: space + 1] > 0, size, 0))


def _pairs(counts: np.ndarray, space: int, most: int) -> list[tuple[int, ...]]:
    """The fullest fillings by one or two pieces, larger pieces first."""
    floor = _place(counts, space)
    x = np.flatnonzero(counts[: space + 1] > 0)
    if not len(x):
        return [()]
    y = floor[space - x]
    alone = (y == x) & (counts[x] < 2)
    y[alone] = floor[x[alone] - 1]
    y = np.minimum(y, x)
    order = np.lexsort((-x, -(x + y)))[:most]
    return [tuple(int(v) for v in (x[i], y[i]) if v) for i in order]


def fillings(counts: np.ndarray, largest: int, capacity: int) -> list[tuple[int, ...]]:
    """Undominated fillings of a sequence that holds a piece of the largest length: none can be
    added to, and no piece can be exchanged for a larger one that is left. Least waste first,
    then fewest pieces."""
    left = counts.copy()
    left[largest] -= 1
    space, head = capacity - largest, []
    while space > 0:  # small pieces: fill up until a few complete it
        top = int(_place(left, space)[-1])
        if not top or space <= 3 * top:
            break
        use = min(int(left[top]), space // top - 2)
        head += [top] * use
        left[top] -= use
        space -= use * top
    found = set()
    tops = np.flatnonzero(left[1: space + 1] > 0)[::-1][: 2 * BRANCHES] + 1 if space > 0 else []
    for tail in _pairs(left, space, BRANCHES) if space > 0 else [()]:
        found.add(tail)
    for x in tops:
        left[x] -= 1
        for tail in _pairs(left, space - int(x), 2):
            found.add((int(x), *tail))
        left[x] += 1
    done = set()
    for tail in found:
        done.add(tuple(sorted((*head, *_maximal(left, list(tail), space)), reverse=True)))
    return sorted(done, key=lambda f: (capacity - largest - sum(f), len(f), f))[:BRANCHES]


def _maximal(counts: np.ndarray, tail: list[int], space: int) -> list[int]:
    """Adds pieces and exchanges them for larger ones until the filling is not dominated."""
    left = counts.copy()
    for x in tail:
        left[x] -= 1
    while (slack := space - sum(tail)) > 0:
        add = int(_place(left, slack)[-1])
        if add:
            tail.append(add)
            left[add] -= 1
            continue
        for i, x in enumerate(tail):
            y = int(_place(left, x + slack)[-1])
            if y > x:
                left[x] += 1
                left[y] -= 1
                tail[i] = y
                break
        else:
            break
    return tail


def _bound(counts: np.ndarray, capacity: int) -> int:
    size = np.arange(len(counts))
    return max(-(-int((counts * size).sum()) // capacity), int(counts[capacity // 2 + 1:].sum()))


def _times(counts: np.ndarray, filling: Counter) -> int:
    return min(int(counts[x]) // m for x, m in filling.items())


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    """The incumbent: beside the largest piece always the largest that still fits."""
    counts, out = histogram.copy(), []
    while counts.any():
        largest = int(np.flatnonzero(counts)[-1])
        left, space, took = counts.copy(), capacity - largest, Counter([largest])
        left[largest] -= 1
        while space > 0 and (x := int(_place(left, space)[-1])):
            use = min(int(left[x]), space // x)
            took[x] += use
            left[x] -= use
            space -= use * x
        n = _times(counts, took)
        for x, m in took.items():
            counts[x] -= n * m
        out.append((took, n))
    return out


def complete_bins(histogram: np.ndarray, capacity: int, nodes: int = NODES) -> list[tuple[Counter, int]]:
    """Fillings and how often each is used, in as few sequences as the search can find.

    `histogram[n]` pieces have length n (none of length 0).
    """
    counts = histogram.astype(np.int64).copy()
    best = best_fit(counts, capacity)
    fewest, lower = sum(n for _, n in best), _bound(counts, capacity)
    path: list[tuple[Counter, int]] = []
    used = 0

    def choices():
        largest = int(np.flatnonzero(counts)[-1])
        return iter([Counter((largest, *f)) for f in fillings(counts, largest, capacity)])

    stack = [choices()] if counts.any() and fewest > lower else []
    while stack and nodes > 0:
        if len(path) == len(stack):  # come back from below
            filling, n = path.pop()
            used -= n
            for x, m in filling.items():
                counts[x] += n * m
        filling = next(stack[-1], None)
        if filling is None:
            stack.pop()
            continue
        nodes -= 1
        n = _times(counts, filling)
        for x, m in filling.items():
            counts[x] -= n * m
        path.append((filling, n))
        used += n
        if used + _bound(counts, capacity) >= fewest:
            continue
        if counts.any():
            stack.append(choices())
            continue
        best, fewest = list(path), used
        if fewest == lower:
            break
    return best


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 1, doc_id: str = "doc_id",
                 text: str = "text", with_ids: bool = False) -> DataFrame:
    """`doc_id`, `piece`, `start`, `length`, `ids_crc32` and, if asked for, `ids`: each text's token
    ids and `end_id`, cut into pieces of `capacity` where there are more. Null text is empty."""

    def make():
        encode = encoder(path).encode_many
        end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

        def run(cols):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for d, raw in zip(cols["doc_id"], encode(cols["text"])):
                raw += end
                for p, i in enumerate(range(0, len(raw), step)):
                    part = raw[i:i + step]
                    row = d, p, i // 4, len(part) // 4, zlib.crc32(part), None
                    for k, v in zip(out, row):
                        out[k].append(v)
                    if with_ids:
                        out["ids"][-1] = np.frombuffer(part, dtype="<u4").astype(np.int32)
            return out

        return run

    return row_map(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make,
        "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids,
    )


def pack(pieces: DataFrame, capacity: int, nodes: int = NODES) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces (`length` 1 to `capacity`); every column is kept.

    Pieces are told apart by number only, so repeated rows and null ids are packed like all others;
    no pieces give no rows. Sequences are gapless from offset 0. `pieces` is read twice.
    """
    spark = pieces.sparkSession
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[length] = n
    slots: dict[int, list] = {}
    seen, sequence = Counter(), 0
    for filling, n in complete_bins(histogram, capacity, nodes):
        offset = 0
        for x, m in sorted(filling.items(), reverse=True):
            slots.setdefault(x, []).append((seen[x], seen[x] + n * m, m, sequence, offset))
            seen[x] += n * m
            offset += m * x
        sequence += n
    table = spark.createDataFrame(
        [(x, s) for x, s in slots.items()],
        "length long, slots array<struct<low:long,high:long,per:long,sequence:long,offset:long>>",
    )
    lots = max(1, int(histogram.max()) // LOT)
    numbered = pieces.withColumn("_order", F.monotonically_increasing_id())
    if lots > 1:
        numbered = written(numbered, "packing")
    numbered = rank_within(numbered, ["length"], F.pmod(F.xxhash64("_order"), F.lit(lots)), [F.col("_order")], "_rank")
    rank = F.col("_rank") - 1
    slot = F.filter("slots", lambda s: (s["low"] <= rank) & (rank < s["high"]))[0]
    within = rank - F.col("_slot.low")
    return (
        numbered.join(table, "length").withColumn("_slot", slot)
        .withColumn("sequence_id", F.col("_slot.sequence") + F.floor(within / F.col("_slot.per")))
        .withColumn("offset", F.col("_slot.offset") + (within % F.col("_slot.per")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id",
                   text: str = "text", with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most `capacity` tokens: see `token_pieces` and `pack`."""
    return pack(written(token_pieces(docs, path, capacity, end_id, doc_id, text, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """`sequence_id`, `ids` and `lengths` (of its pieces, for block attention) of pieces with ids.
    A sequence's pieces together are bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts.ids", F.size).alias("lengths")
    )
