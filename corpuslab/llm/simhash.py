"""SimHash near-duplicates, compared on vertical bit planes.

Fingerprints that differ in at most `RADIUS` bits agree on two of four 16-bit blocks, so every
such pair meets under one of six 32-bit keys. What meets is compared bit-sliced: 64 fingerprints
to a machine word and one row of words to a bit; two carry-save counters (ones, twos) and an
overflow mask follow 64 distances at a time, and a block of lanes is left as soon as all are over
the radius.

Two bits find little more than copies: texts that share 0.8 of their 5-word shingles lie at 3 to 11
bits and more, which no blocks of 64 bits cover. Those are found by the least hashes of their
shingles, meet under keys of several of them, and are verified by the exact Jaccard similarity.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import components, parted_by_ids, row_map, written

RADIUS = 2
#: Words of a shingle and the least Jaccard similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Keys of a text and least hashes in each. A pair at 0.8 shares none by a chance of
#: (1 - 0.8**5)**40, which is 1.3e-7.
BANDS, BAND_ROWS = 40, 5
#: Groups of candidates over this many texts are cut into pieces that meet pairwise.
TEXTS = 1024
#: Groups over this many fingerprints are cut into pieces whose pairs are separate groups.
PIECE = 2048
#: Groups from this size on are compared query block by query block, smaller ones by shifts.
WIDE = 96
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """Bitwise majority of the XXH64 of 3-word shingles, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(42)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        part = h[i:i + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of words: bit j of row i is bit i of fingerprint j."""
    n = len(prints)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    out = np.zeros((64, (n + 63) // 64 * 8), dtype=np.uint8)
    out[:, : (n + 7) // 8] = np.packbits(bits.T, axis=1, bitorder="little")
    return out.view("<u8")


def _near(differing, shape, alive=None) -> np.ndarray:
    """Lanes within the radius; `differing(i, at)` gives words of lanes that differ in bit i.

    Blocks are rows of lanes (or single words); those that are over the radius everywhere are left.
    """
    ones, twos, over = (np.zeros(shape, dtype=np.uint64) for _ in range(3))
    at = np.arange(shape[0])
    if alive is not None:
        over |= ~alive
    result = np.zeros(shape, dtype=np.uint64)
    for i in range(64):
        d = differing(i, at)
        carry = ones & d
        ones ^= d
        over |= (twos & carry) | (ones & (twos | carry))
        twos |= carry
        if i % 8 == 7 and i < 63:
            live = (over != FULL).any(axis=1)
            if not live.all():
                at, ones, twos, over = at[live], ones[live], twos[live], over[live]
                if not len(at):
                    return result
    result[at] = ~over
    return result


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little", axis=-1).astype(bool)


def _shifted(p: np.ndarray, by: int) -> np.ndarray:
    """Lane j of the result is lane j + `by`."""
    word, bit = divmod(by, 64)
    low = p[:, word:]
    out = np.zeros_like(p)
    if bit:
        out[:, : low.shape[1]] = low >> np.uint64(bit)
        out[:, : max(0, low.shape[1] - 1)] |= low[:, 1:] << np.uint64(64 - bit)
    else:
        out[:, : low.shape[1]] = low
    return out


def near_pairs(prints: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions within the radius inside runs of equal `runs` (small groups, one after another)."""
    first, second = [], []
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]]) if len(runs) else np.zeros(0, dtype=int)
    lengths = np.diff(np.r_[starts, len(runs)])
    size = np.repeat(lengths, lengths)
    index, p = np.arange(len(prints)), None
    for by in range(1, int(lengths.max(initial=1))):
        long = size[index] > by
        if p is None or long.sum() < 0.7 * len(long):  # lanes of shorter groups are done
            index = index[long]
            p = planes(prints[index])
        same = np.zeros(len(index), dtype=bool)
        same[:-by] = runs[index[by:]] == runs[index[:-by]]
        q = _shifted(p, by)
        mask = np.zeros(p.shape[1] * 64, dtype=np.uint8)
        mask[: len(same)] = same
        alive = np.packbits(mask, bitorder="little").view("<u8")[:, None]
        near = _lanes(_near(lambda i, at: (p[i, at] ^ q[i, at])[:, None], alive.shape, alive)[:, 0])[: len(same)]
        hit = np.flatnonzero(near & same)
        first.append(index[hit])
        second.append(index[hit + by])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def near_labels(prints: np.ndarray) -> np.ndarray:
    """For one large group: the position of the first member each one is linked with, directly or not."""
    n, p, label = len(prints), planes(prints), np.arange(len(prints))
    for start in range(0, n, 64):
        q = prints[start:start + 64]
        full = np.where(q[None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1), FULL, np.uint64(0))
        near = _lanes(_near(lambda i, at: p[i][None, :] ^ full[i][at][:, None], (len(q), p.shape[1])))[:, :n]
        for row in near:
            met = np.unique(label[row])
            if len(met) > 1:
                label[np.isin(label, met[1:])] = met[0]
    return label


def _links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between neighbours of a group: enough to connect all that is within the radius."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    wide = np.repeat(sizes >= WIDE, sizes)
    a, b = near_pairs(prints[~wide], keys[~wide])
    small = prints[~wide]
    first, second = [small[a]], [small[b]]
    for s, m in zip(starts[sizes >= WIDE], sizes[sizes >= WIDE]):
        group = prints[s:s + m]
        label = near_labels(group)
        order = np.argsort(label, kind="stable")
        chained = np.flatnonzero(label[order[1:]] == label[order[:-1]])
        first.append(group[order[chained]])
        second.append(group[order[chained + 1]])
    return np.concatenate(first), np.concatenate(second)


def _compare(batches):
    """Rows arrive sorted by (g, fp): whole groups are compared as soon as they are complete."""
    held_g, held_p = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    names = ["a", "b"]

    def out(g, p):
        a, b = _links(g, p)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=names)

    for batch in batches:
        held_g = np.concatenate([held_g, batch.column("g").to_numpy(zero_copy_only=False)])
        held_p = np.concatenate([held_p, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(held_g):
            continue
        cut = np.searchsorted(held_g, held_g[-1], side="left")
        if cut:
            yield out(held_g[:cut], held_p[:cut])
            held_g, held_p = held_g[cut:], held_p[cut:]
    if len(held_g):
        yield out(held_g, held_p)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `fp` (the fingerprint as a signed long) of each row's whole text. Null text: 0."""

    def make():
        def run(cols):
            prints = np.array([fingerprint(t) for t in cols["text"]], dtype=np.uint64)
            return {"doc_id": cols["doc_id"], "fp": prints.view(np.int64)}

        return run

    return row_map(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make, "doc_id long, fp long"
    )


# ---------------------------------------------------------------- similar shingles


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of the runs of `SHINGLE` words; a shorter text is one run."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(xxh64_intdigest, words, repeat(42)), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(h))
    if not width:
        return h
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i]
    return np.unique(_mixed(out))


def band_keys(found: np.ndarray) -> np.ndarray:
    """`BANDS` keys of a set of shingles, each of `BAND_ROWS` least hashes; none of an empty set."""
    if not len(found):
        return np.zeros(0, dtype=np.int64)
    random = np.random.default_rng(8).integers(0, 2**63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
    add, factor = random[0], random[1] | np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, FULL)
    for i in range(0, len(found), 1024):
        least = np.minimum(least, ((found[i:i + 1024, None] ^ add) * factor).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out.view(np.int64)


def _alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all pairs that share a key and are similar."""
    keys = np.array([band_keys(x) for x in sets]).reshape(len(sets), -1)
    label, links = np.arange(len(sets)), []
    for i in range(1, len(sets)):
        met = np.flatnonzero((keys[:i] == keys[i]).any(axis=1))
        met = met[label[met] != label[i]]
        while len(met):
            j = int(met[0])
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                links.append((i, j))
                label[label == label[j]] = label[i]
                met = met[label[met] != label[i]]
            else:
                met = met[1:]
    return links


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`doc_id`, `fp`, `set_a` and `set_b` (a digest of the set of shingles), `keys` of each row."""

    def make():
        from xxhash import xxh64_intdigest

        def run(cols):
            sets = [shingles(t) for t in cols["text"]]
            digests = [np.array([xxh64_intdigest(x.tobytes(), s) for x in sets], dtype=np.uint64).view(np.int64) for s in (1, 2)]
            prints = np.array([fingerprint(t) for t in cols["text"]], dtype=np.uint64)
            return {"doc_id": cols["doc_id"], "fp": prints.view(np.int64), "set_a": digests[0], "set_b": digests[1],
                    "keys": [band_keys(x) for x in sets]}

        return run

    return row_map(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make,
        "doc_id long, fp long, set_a long, set_b long, keys array<long>",
    )


def _verified(similarity: float):
    def run(batches):
        """Rows arrive sorted by g: whole groups are compared as soon as they are complete."""
        held, group = [], None

        def out():
            links = _alike([x[1] for x in held], similarity)
            return pa.RecordBatch.from_arrays(
                [pa.array([held[link[side]][0] for link in links], type=pa.int64()) for side in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            for g, fp, text in zip(*[batch.column(c).to_pylist() for c in ("g", "fp", "text")]):
                if g != group and held:
                    yield out()
                    held = []
                group = g
                held.append((fp, shingles(text)))
        if held:
            yield out()

    return run


def similar_links(sketched: DataFrame, docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Links `a`, `b` between fingerprints of texts whose sets of shingles are equal or similar.

    Sets under one key are candidates of each other. Every set of a connected group of candidates
    meets every other of the group in some task, and only texts of such groups are shuffled.
    """
    sets = written(sketched.groupBy("set_a", "set_b").agg(
        F.min("fp").alias("fp"), F.max("fp").alias("last"), F.first("keys").alias("keys")
    ), "simhash-sets")
    equal = sketched.select("set_a", "set_b", F.col("fp").alias("b")).distinct().join(
        sets.where("fp <> last").select("set_a", "set_b", F.col("fp").alias("a")), ["set_a", "set_b"]
    ).select("a", "b")
    keyed = sets.select("set_a", F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min("set_a").alias("b"), F.max("set_a").alias("last")).where("b <> last")
    groups = components(keyed.join(first, "key").select(F.col("set_a").alias("a"), "b"))
    members = written(
        sets.select("set_a", "set_b", "fp").join(groups, F.col("set_a") == F.col("node")).select("set_a", "set_b", "fp", "root"),
        "simhash-candidates",
    )

    def make():
        from xxhash import xxh64_intdigest

        def run(cols):
            found = [shingles(t).tobytes() for t in cols["text"]]
            a, b = [np.array([xxh64_intdigest(x, s) for x in found], dtype=np.uint64).view(np.int64) for s in (1, 2)]
            return {"set_a": a, "set_b": b, "text": cols["text"]}

        return run

    named = row_map(docs.select(F.col(text).alias("text")), make, "set_a long, set_b long, text string")
    texts = parted_by_ids(named, members, "set_a")[1].groupBy("set_a", "set_b").agg(F.min("text").alias("text"))
    pieces = F.ceil(F.col("n") / TEXTS).cast("int")
    own = F.pmod(F.xxhash64("set_a", "set_b"), pieces).cast("int")
    others = F.when(pieces == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), pieces - 1), own))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    grouped = (
        members.join(sizes, "root").join(texts, ["set_a", "set_b"])
        .select("fp", "text", "root", own.alias("own"), F.explode(others).alias("other"))
        .select("fp", "text", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("g"))
        .repartition("g").sortWithinPartitions("g")
    )
    return grouped.mapInArrow(_verified(similarity), "a long, b long").unionByName(equal)


def near_links(prints: DataFrame) -> DataFrame:
    """Links `a`, `b` between distinct fingerprints (`fp`): all that are within the radius are
    connected by them. Every pair within the radius has been compared."""
    fp = F.col("fp")
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = F.array(*[
        F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
        for n, (i, j) in enumerate(combinations(range(4), 2))
    ])
    keyed = prints.select("fp", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(sizes, "key")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    own = F.pmod(F.xxhash64("fp"), pieces).cast("int")
    # group (key, i, j) holds pieces i and j of a key; a small key is group (key, 0, 0)
    others = F.when(pieces == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), pieces - 1), own)
    )
    grouped = (
        met.select("fp", "key", own.alias("own"), F.explode(others).alias("other"))
        .select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"))
        .repartition("g").sortWithinPartitions("g", "fp")
    )
    return grouped.mapInArrow(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    similarity: float | None = None) -> DataFrame:
    """One row per document: `doc_id`, `fingerprint` (16 hex digits), `component_id`.

    `component_id` is the smallest id reachable over links of at most two differing bits
    and, where a `similarity` is given, links of texts with at least this Jaccard similarity of their
    distinct 5-word shingles.
    Texts are split at ASCII white space after lower-casing A-Z. Null, empty and blank texts have
    fingerprint zero and link like any other. A row with a null id has a component too, that of
    the others in it (null if all ids are null). Repeated rows come out as often as they come in.
    Equal fingerprints are one node, so copies are never paired; an empty table stays empty.
    """
    alike = similarity is not None
    prints = written(sketches(docs, doc_id, text) if alike else fingerprints(docs, doc_id, text), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = near_links(distinct.select("fp"))
    if alike:
        links = links.unionByName(similar_links(prints, docs, text, similarity))
    roots = components(links)
    linked = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    linked = written(linked, "simhash-roots")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = linked.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
