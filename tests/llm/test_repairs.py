"""Structure repair, curriculum mixing and periodic runs against brute force on small tables."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import curriculum, periodic_runs, queries, structure_repair
from corpuslab.llm.structure_repair import ASSISTANT, NEXT, NONE, USER

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---------------------------------------------------------------- structure repair


def kept_state(role, state):
    if role == "s":
        return 1 if state == NONE else None
    if role == "u":
        return USER if state != USER else None
    return ASSISTANT if role == "a" and state == USER else None


def least_edits(symbols):
    """(cost, edits) by a search over (cost, edits) in order."""
    heap, seen = [(0, "", 0, NONE)], set()
    while True:
        cost, edits, j, state = heapq.heappop(heap)
        if j == len(symbols) and state in (NONE, ASSISTANT):
            return cost, edits
        if (j, state) in seen:
            continue
        seen.add((j, state))
        heapq.heappush(heap, (cost + 5, edits + "I", j, NEXT[state]))
        if j < len(symbols):
            x = int(symbols[j])
            heapq.heappush(heap, (cost + 2, edits + "D", j + 1, state))
            if x > 1:
                heapq.heappush(heap, (cost + 1 + 5 * (x % 2), edits + "R", j + 1, NEXT[state]))
                after = kept_state("suao"[(x - 2) // 2], state)
                if after is not None:
                    heapq.heappush(heap, (cost + 5 * (x % 2), edits + "K", j + 1, after))


@pytest.mark.parametrize("seed", range(4))
def test_block_tables_give_the_least_edits(seed):
    t, rng = structure_repair.tables(), random.Random(seed)
    for _ in range(1500):
        symbols = "".join(rng.choice("123456789") for _ in range(rng.randint(0, 13)))
        vector, cost = t.back(symbols, 0)
        edits, state = t.edits(symbols, 0, NONE)
        found = "".join(x for x, _ in edits) + t.closing[state]
        assert (cost + t.vectors[vector][NONE], found) == least_edits(symbols)


def test_vectors_are_few_and_normal():
    vectors = structure_repair.tables().vectors
    assert len(vectors) < 40 and all(min(v) == 0 for v in vectors) and len(set(vectors)) == len(vectors)


def by_hand(rows):
    """What `audit` says of rows (conv_id, turn, role, text)."""
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        seen, faults, symbols = set(), [0] * 4, ""
        for _, _, role, text in turns:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not marks else 2 if (role, text) in seen else 3 if marks[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            symbols += "1" if fault in (1, 2) else str(2 + 2 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + (fault == 3))
        cost, edits = least_edits(symbols)
        state, said, at = NONE, [], 0
        for e in edits:
            if e == "I":
                state = NEXT[state]
                said.append(("user:", "assistant:")[state == ASSISTANT])
                continue
            _, _, role, text = turns[at]
            at += 1
            if e == "K":
                state = kept_state(role[:1], state)
                said.append(f"{role}:{text}")
            elif e == "R":
                state = NEXT[state]
                said.append(("user:", "assistant:")[state == ASSISTANT] + text)
        known = [t for has, t, _, _ in turns if has]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[c] = (gaps, *faults[1:], illegal, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


TURNS = "conv_id long, turn long, role string, text string, key string, n long, mark int, piece int"


def turn_frame(spark, rows):
    """Turns with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], TURNS)


def some_turns(seed, convs=40):
    rng = random.Random(seed)
    for c in [None, *range(convs)]:
        for _ in range(rng.randint(1, 12)):
            yield (c, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]),
                   rng.choice(["a.", "b!", "c", " \t\n", "", None, "d? ", "é. ", "x" * 50 + "."]))


@pytest.mark.parametrize("bits", [structure_repair.PIECE_BITS, 2])
def test_repair_by_hand(spark, monkeypatch, bits):
    monkeypatch.setattr(structure_repair, "PIECE_BITS", bits)
    rows = list(some_turns(bits)) + [(99, i, ("user", "assistant")[i % 3 == 1], f"t{i % 50}.") for i in range(300)]
    turns = turn_frame(spark, rows).repartition(5)
    ids = spark.createDataFrame([(i,) for i in [None, 99, 500, *range(40)]], "conv_id long")
    got = {r[0]: tuple(r)[1:] for r in structure_repair.audit(structure_repair.repair(turns), ids).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got == by_hand(rows) | {500: (0, 0, 0, 0, 0, 0, "", empty)}


def test_repair_of_an_empty_table(spark):
    turns = turn_frame(spark, [])
    edits = structure_repair.repair(turns)
    assert edits.collect() == [] and structure_repair.audit(edits, turns).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "hi."), (1, 1, "user", ""), (1, 2, "user", "and?"), (1, 3, "assistant", "so.")]
    got = [(r["edit"], r["role"], r["text"]) for r in structure_repair.repair(turn_frame(spark, rows)).collect()]
    assert got == [("D", None, None), ("D", None, None), ("K", "user", "and?"), ("K", "assistant", "so.")]


def test_damage(spark):
    rows = [(c, t, "assistant", f"c{c}. t{t}!") for c in range(40) for t in range(8)] + [(None, None, None, None)]
    got = sorted(tuple(r) for r in queries.damaged_turns(turn_frame(spark, rows)).where("conv_id is not null").collect())
    want = []
    for c, t, role, text in rows[:-1]:
        fault = zlib.crc32(f"{c}:{t}".encode()) % 20
        role, text = "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want += [(c, t, role, text)] * (fault != 0) * (2 if fault == 3 else 1)
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["op11_structure_repair", "op12_curriculum_mixing"])
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want))


# ---------------------------------------------------------------- curriculum mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, place int, piece int, weight int, `order` int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4, 5, 6) for i, t, s in rows], DOCS)


def levelled(sizes, weights, budget, repeats):
    capped = set()
    while True:
        free = sum(w for i, w in enumerate(weights) if i not in capped)
        if not free:
            return [repeats * s for s in sizes]
        level = (budget - sum(repeats * sizes[i] for i in capped)) / free
        more = {i for i, (s, w) in enumerate(zip(sizes, weights)) if repeats * s < level * w} | capped
        if more == capped:
            return [min(repeats * s, w * level) for s, w in zip(sizes, weights)]
        capped = more


@pytest.mark.parametrize("sizes, weights", [
    ([10, 20, 3000], [1, 2, 1]), ([1, 1, 1, 500], [3, 2, 1, 1]), ([5], [2]), ([0, 7], [1, 1]), ([100, 100], [0, 1]), ([0, 0], [1, 1]),
])
def test_targets(spark, sizes, weights):
    rows = spark.createDataFrame([(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))], "i int, source_size long, weight double")
    got = [r["target"] for r in curriculum.targets(rows, float(sum(sizes)), 3).orderBy("i").collect()]
    assert got == pytest.approx(levelled(sizes, weights, sum(sizes), 3))


def mix_rows(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(["b", "a", None, "é", "hot", "hot", "hot"]))
            for i in range(400)]
    return rows + rows[:20] + [(None, "x y", "a"), (None, None, None), (7, "", "only empty")] + [(3, "same text", "rare")] * 9


@pytest.mark.parametrize("lot", [curriculum.LOT, 3])
def test_mix(spark, monkeypatch, lot):
    monkeypatch.setattr(curriculum, "LOT", lot)
    rows = mix_rows(1)
    mix = curriculum.mixed(frame(spark, rows).repartition(5), queries.SCHEDULES)
    got = mix.collect()
    again = curriculum.mixed(frame(spark, rows[::-1]).repartition(3), queries.SCHEDULES)
    key = lambda r: repr((r["doc_id"], r["source"], r["size"], r["taken"], r["passes"]))
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    assert len(got) == len(rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = levelled(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))], sum(sizes), 3)
    for name, size, target in zip(names, sizes, want):
        mine = [r for r in got if r["source"] == name]
        assert {r["source_size"] for r in mine} == {size} and [r["target"] for r in mine] == pytest.approx([target] * len(mine))
        assert abs(sum(r["taken"] for r in mine) - target) < 1.001
        for r in mine:
            assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["words"] for p in r["passes"])
            assert [p["time"] for p in r["passes"]] == sorted(p["time"] for p in r["passes"])
    order = [r["time"] for r in curriculum.training_order(mix).collect()]
    assert order == sorted(order) and len(order) == sum(len(r["passes"]) for r in got)


def test_times_follow_the_schedule(spark):
    knots = [(0, 0), (0.25, 4), (0.5, 4), (0.5001, 0), (1, 0)]
    spans = curriculum.segments(knots)
    schedule = curriculum._schedule(knots)
    rows = spark.range(0, 1000).select("id", curriculum.time_of(F.col("id"), F.lit(1000), schedule).alias("t")).collect()

    def demand(t):
        return sum((w * x + a * x * x / 2) for s, width, w, a, _ in spans for x in [min(max(t - s, 0), width)])

    for i, t in rows:
        assert 0 <= t <= 1 and demand(t) / curriculum.integral(knots) == pytest.approx(i / 1000, abs=1e-9)
    with pytest.raises(ValueError):
        curriculum.segments([(0, 1), (0.9, 1)])


def test_schedules_by_name_and_empty_table(spark):
    rows = [(i, "a b c d", "xy"[i % 2]) for i in range(40)]
    mix = curriculum.mixed(frame(spark, rows), [[(0, 1), (1, 1)]], by_source={"y": [(0, 0), (1, 0)]}, share=0.5).collect()
    assert sum(r["taken"] for r in mix if r["source"] == "x") == 80 and not any(r["taken"] for r in mix if r["source"] == "y")
    assert curriculum.mixed(frame(spark, []), queries.SCHEDULES).collect() == []


# ---------------------------------------------------------------- periodic runs


def runs_by_hand(words, least):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if len(part) >= max(least, 2 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_runs_by_hand(seed):
    rng = random.Random(seed)
    for _ in range(500):
        n, letters = rng.randint(0, 70), "abcdefgh"[:rng.choice([1, 2, 3, 8])]
        words = [rng.choice(letters) for _ in range(n)]
        if n and rng.random() < 0.5:
            words = (words[:rng.randint(1, n)] * 70)[:n] + words[:rng.randint(0, 9)]
        for least in (2, 5, 12):
            assert periodic_runs.text_runs(words, least) == runs_by_hand(words, least)


def test_long_runs():
    words = (["a", "b", "c"] * 30_000)[:80_000]
    assert periodic_runs.text_runs(["x", *words, "y"]) == [(1, 80_000, 3)]
    assert periodic_runs.text_runs([str(i) for i in range(5_000)] * 4) == [(0, 20_000, 5_000)]


def dropped_by_hand(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_periodic_documents(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "a b " * 12, "na na na\n" * 9, "z " * 20_000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "b " * 12, "s"), (3, texts[3], "s")]
    got = periodic_runs.periodic_runs(frame(spark, rows)).collect()
    want = []
    for i, t, _ in rows:
        words = WORD.findall(t or "")
        runs = [(0, 20_000, 1)] if len(words) == 20_000 else runs_by_hand(words, 12)
        want.append((i, len(words), runs, " ".join(dropped_by_hand(words, runs))))
    assert sorted(map(repr, ((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got))) == sorted(map(repr, want))
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []


def test_period_query_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    looped = 0
    for i, t in docs:
        words = WORD.findall(t or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g, looped = h // 10, looped + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        if n > 3000:
            continue
        runs = runs_by_hand(words, 12)
        s, length, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
            "".join(f"{x},{y},{z}\n" for x, y, z in runs), " ".join(dropped_by_hand(words, runs)))]
        assert got[i] == (len(runs), s, length, q, 1000 * length // q if runs else None, *sha)
    assert looped and len(got) == len(docs)
