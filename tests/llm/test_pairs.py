"""SimHash, embedding graph and decontamination against brute force on small tables."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslab.llm import decontaminate, embeddings, simhash
from corpuslab.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, key long, hash long"


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def roots(n, links):
    parent = list(range(n))
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(n)]


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4, 5) for i, t in rows], DOCS)


def simhash_by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "É b c d e e e e e e", "x " * 5000, "a\x1cb c\x0bd e"])
def test_fingerprint_by_hand(text):
    assert simhash.fingerprint(text) == simhash_by_hand(text)


def some_prints(seed, n=40):
    rng = np.random.default_rng(seed)
    out = set()
    for base in rng.integers(0, 2**63, n, dtype=np.uint64):
        for _ in range(12):
            x = int(base)
            for _ in range(rng.integers(0, 4)):
                x ^= 1 << int(rng.integers(64))
            out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("seed", [1, 2])
def test_bit_sliced_comparison(seed):
    p = some_prints(seed)
    near = np.bitwise_count(p[:, None] ^ p[None]) <= 2
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    one_group = np.zeros(len(p), dtype=np.int64)
    assert set(zip(*[x.tolist() for x in simhash.near_pairs(p, one_group)])) == want
    runs = np.sort(np.random.default_rng(seed).integers(0, 25, len(p)))
    assert set(zip(*[x.tolist() for x in simhash.near_pairs(p, runs)])) == {(i, j) for i, j in want if runs[i] == runs[j]}
    assert simhash.near_labels(p).tolist() == roots(len(p), want)


def test_small_and_empty_groups():
    for n in (0, 1):
        a, b = simhash.near_pairs(np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64))
        assert not len(a) and not len(b)


@pytest.mark.parametrize("piece", [2048, 16])
def test_links_of_prints(spark, monkeypatch, piece):
    """All prints within two bits are connected, also where groups are cut into pieces."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    base = 0x0123456789ABCDEF
    dense = {base} | {base ^ (1 << i) for i in range(64)} | {base ^ (1 << i) ^ (1 << (i + 9)) for i in range(40)}
    p = np.array(sorted(dense | set(some_prints(3).tolist())), dtype=np.uint64)
    table = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    got = components(simhash.near_links(table)).collect()
    signed = p.view(np.int64).tolist()
    at = {x: i for i, x in enumerate(signed)}
    group = {at[r["node"]]: at[r["root"]] for r in got}
    near = np.bitwise_count(p[:, None] ^ p[None]) <= 2
    want = roots(len(p), zip(*np.nonzero(np.triu(near, 1))))
    mine = [group.get(i, i) for i in range(len(p))]
    assert len({(a, b) for a, b in zip(mine, want)}) == len(set(want)) == len(set(mine))


def test_near_duplicates(spark):
    rows = [(5, None), (9, ""), (7, "  "), (3, "same words in here"), (1, "SAME words in here"), (3, "same words in here"),
            (None, "same words in here"), (20, "lonely text of its own"), (None, "nobody knows this one"), (21, "w " * 30000)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    print_of = [simhash_by_hand(t) for _, t in rows]
    group = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(print_of[i] ^ print_of[j]).count("1") <= 2])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, print_of, group)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("most", [1024, 4])
def test_similar_texts(spark, monkeypatch, most):
    """All pairs at 0.8 of 5-word shingles are connected, no other, also where groups are cut into pieces."""
    monkeypatch.setattr(simhash, "TEXTS", most)
    rng = np.random.default_rng(5)
    texts = [None, "", "one two", "one  TWO", "one two three"]
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 5000, 90)]
        for changes in (0, 1, 1, 1, 2, 2, 3, 4):
            words = list(base)
            for at in rng.integers(0, 90, changes):
                words[at] = f"x{rng.integers(5000)}"
            texts.append(" ".join(words))

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, prints = [grams(t) for t in texts], [simhash_by_hand(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    near = [(i, j) for i, j in pairs if bin(prints[i] ^ prints[j]).count("1") <= 2]
    alike = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(set(alike) - set(near)) > 20
    docs = frame(spark, list(enumerate(texts)))
    for similarity, links in ((0.8, near + alike), (None, near)):
        got = simhash.near_duplicates(docs, similarity=similarity).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(roots(len(texts), links)))
    import corpus_pipeline

    kept = corpus_pipeline.near_copies_removed(spark, docs, "").select("doc_id").collect()
    # the stage goes by the operator's contract, bits alone
    assert sorted(r[0] for r in kept) == sorted(set(roots(len(texts), near)))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (5, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- decontamination

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def by_hand(docs, items):
    found = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n and item is not None else 0):
            found.setdefault(tuple(w[k:k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, met = words(text), set(), set()
        for n in {len(k) for k in found}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in found:
                    hit.update(range(k, k + n))
                    met |= found[tuple(w[k:k + n])]
        names = ",".join(sorted(map(str, met)))
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def decontaminated(spark, docs, items):
    items = spark.createDataFrame([(i, t, 1, "k") for i, t in items], "item_id long, text string, row long, kind string")
    return sorted((tuple(r) for r in decontaminate.contamination(frame(spark, docs), items).collect()), key=str)


def test_contamination_by_hand(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    items = [(1, passage), (2, "short one here"), (3, "uno"), (4, None), (5, ""), (6, "!!! ..."), (None, "left out of it all"),
             (10, passage), (11, "a a a a a a a a a a a a"), (2, "short one here"), (12, "é1 2ü 3 4 5 6 7 8 9 10")]
    docs = [(1, f"before {passage} after"), (2, passage.upper().replace(" ", "-")), (3, " ".join(passage.split()[:9])),
            (4, " ".join(passage.split()[2:12]) + " x"), (5, None), (6, ""), (7, "a " * 40), (8, "a " * 9), (9, "Short, one; here! uno"),
            (9, "Short, one; here! uno"), (None, f"{passage} {passage}"), (11, "left out of it all"), (12, "É1 é1 2ü 3 4 5 6 7 8 9 10"),
            (13, f"{'pad ' * 3000}{passage}{' pad' * 3000}")]
    assert decontaminated(spark, docs, items) == by_hand(docs, items)


def test_contamination_of_random_texts(spark):
    rng = np.random.default_rng(4)
    def text(n):
        return " ".join(rng.choice(["a", "b", "c"], n))
    items = [(i, text(int(rng.integers(1, 16)))) for i in range(12)]
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(60)]
    assert decontaminated(spark, docs, items) == by_hand(docs, items)


def test_contamination_of_empty_tables(spark):
    clean = hashlib.sha256(b"").hexdigest()
    assert decontaminated(spark, [(1, "some words")], []) == [(1, 2, 0, 0, clean, False)]
    assert decontaminated(spark, [], [(1, "some words")]) == []


def test_every_shared_span_gives_a_fingerprint():
    rng = np.random.default_rng(8)
    for _ in range(50):
        span = [f"s{i}".encode() for i in rng.integers(0, 4, 10)]
        a = [b"x"] * int(rng.integers(0, 9)) + span + [b"y"] * 7
        b = [b"p"] * int(rng.integers(0, 9)) + span + [b"q"] * 3
        every = lambda g: np.ones(len(g), dtype=bool)
        one, two = ({h["hash"] for h in decontaminate._search(t, [], every)} for t in (a, b))
        assert one & two


# ---------------------------------------------------------------- embeddings


def cosines(rows):
    x = np.array([r for r in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CLUSTER", 60)
    monkeypatch.setattr(embeddings, "LARGEST", 90)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x[50:120] = x[0] + 0.12 * rng.standard_normal((70, 16))  # a group of near copies
    x[120:150] = x[1]  # and one of equal vectors
    x[150:200] = x[200:250] + 0.05 * rng.standard_normal((50, 16))
    x[250] = 3 * x[251]
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), "l", 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label string, node long")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(table).collect()}
    near = cosines(x) >= 0.95
    links = near.sum(axis=1) - 1
    mine = np.array([got[i]["n_links"] for i in range(400)])
    assert (mine <= links).all() and mine.sum() >= 0.9 * links.sum()
    want = roots(400, zip(*np.nonzero(np.triu(near, 1))))
    assert np.mean([got[i]["component_id"] == w for i, w in enumerate(want)]) > 0.97
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(400))


def test_low_recall_is_seen_and_mended(spark, monkeypatch):
    """A hot group hides no missed link, and few clusters are audited too and compared whole."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 16))
    x[60:160] = x[0] + 0.05 * rng.standard_normal((100, 16))
    x[200:250] = x[150:200] + 0.05 * rng.standard_normal((50, 16))
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    near = cosines(x) >= 0.95
    links = near.sum(axis=1) - 1
    assert (links > 50).sum() > 90 and ((links > 0) & (links < 5)).sum() > 50
    nodes = embeddings.distinct_vectors(table.selectExpr("vec_id id", "embedding v")).withColumn("audited", F.lit(True))
    node = {r["first_id"]: r["node"] for r in nodes.collect()}
    hot = [(node[i], int(n), -1) for i, n in enumerate(links) if n > 50]
    found = spark.createDataFrame(hot, "node long, links long, other long")
    assert abs(embeddings.audit(nodes, found, 0.95) - len(hot) / (links > 0).sum()) < 1e-9
    calls = []
    monkeypatch.setattr(embeddings, "audit", lambda *a: calls.append(a) or 0.0)
    got = {r["vec_id"]: r for r in embeddings.near_vectors(table).collect()}
    assert len(calls) == 1 and [got[i]["n_links"] for i in range(300)] == links.tolist()
    assert [got[i]["component_id"] for i in range(300)] == roots(300, zip(*np.nonzero(np.triu(near, 1))))


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (None, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (2, [1.0, -0.0]), (None, None), (10, [-0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embeddings.near_vectors(table).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, None)]
    linked = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False)]
    assert got == sorted(alone + linked, key=str)
    assert embeddings.near_vectors(table.limit(0)).collect() == []


def test_lists_are_pruned_and_searchable():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 8))
    x[100:140] = x[0] + 0.02 * rng.standard_normal((40, 8))
    lists = embeddings.pruned_lists(embeddings.unit(x))
    assert lists.shape[1] == embeddings.DEGREE and (lists[:, 0] >= 0).all()
    assert not any(i in r for i, r in enumerate(lists))
    table = embeddings.both_ways([r[r >= 0] for r in lists], 300)
    by, to = embeddings.in_range(x, table, x, np.full(300, -1), 0.95)  # as strangers: medoids only
    near = cosines(x) >= 0.95
    found = np.zeros_like(near)
    found[by, to] = True
    assert not (found & ~near).any() and found.sum() >= 0.9 * near.sum()


@pytest.mark.parametrize("bits", [26, 3])
def test_rows_parted_by_ids(spark, monkeypatch, bits):
    from corpuslab.llm import common

    monkeypatch.setattr(common, "MOST_BITS", max(bits, 7))
    rows = spark.createDataFrame([(i, "t") for i in range(500)] + [(None, "n"), (7, "again")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(None,), (7,)], "doc_id long")
    others, concerned = common.parted_by_ids(rows, ids, "doc_id")
    a, b = [r["doc_id"] for r in others.collect()], [r["doc_id"] for r in concerned.collect()]
    assert len(a) + len(b) == 502 and None in a
    assert not {i for i in a if i is not None} & set(range(0, 500, 7)) and b.count(7) == 2
    none, all_of = common.parted_by_ids(rows, ids.limit(0), "doc_id")
    assert none.count() == 502 and all_of.count() == 0
