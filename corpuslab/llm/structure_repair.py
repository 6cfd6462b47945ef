"""Cheapest repair of conversations' turn structure, by Four-Russians block tables.

A repaired conversation is empty, or has an optional system turn and then user and assistant turns
by turns. Turns are kept (0), get the other role (1) or are deleted (2, and must be if blank or
repeated); empty user and assistant turns can be inserted anywhere (5); a truncated turn that stays
costs 5 more.

Each turn is a symbol of ten. From the end of a conversation backward, the costs to finish from each
of the four states form a vector. Less its smallest cost it is one of a few normalised vectors, so a
table gives for each normalised vector and each block of four symbols the vector before the block:
a conversation is read by one lookup a block. A block is then expanded backward, symbol by symbol from
the vector behind it, to trace edits forward: at each turn the edit with the least letter that
still leads to the least cost, so ties go to the least string of edits.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import written

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Symbols of a block.
BLOCK = 4
#: Turns of a conversation whose symbols are in one row: 2 to the power of this.
PIECE_BITS = 12
#: States: nothing yet, after system, after user, after assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the one role that may be inserted or given in a state.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a kept role's initial, where it is allowed.
KEEP = ({NONE: SYSTEM}, {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: Costs to finish where no turn is left.
FINAL = (0, 2 * INSERT, INSERT, 0)

SPACES = " \t\n\x0b\f\r"
BLANK, DUPLICATE, CUT = 1, 2, 3


def _kept(symbol: int, state: int) -> tuple[int, int] | None:
    """(cost, next state) of keeping a symbol's turn. Symbols: 0 no turn, 1 must go, then 2 + 2 * role
    + truncated, with roles by initial s, u, a and any other."""
    role, cut = divmod(symbol - 2, 2)
    return (TRUNCATED * cut, KEEP[role][state]) if symbol > 1 and state in KEEP[role] else None


def _options(symbol: int, state: int, behind) -> list[tuple[str, float, int]]:
    """(letter, whole cost, next state) of the edits of a turn, inserts apart."""
    found = [("D", DELETE + behind[state], state)]
    kept = _kept(symbol, state)
    if kept:
        found.append(("K", kept[0] + behind[kept[1]], kept[1]))
    if symbol > 1:
        found.append(("R", REROLE + TRUNCATED * (symbol % 2) + behind[NEXT[state]], NEXT[state]))
    return found


def before(symbol: int, behind: tuple) -> tuple:
    """Costs to finish from each state with one more turn in front."""
    if symbol == 0:
        return behind
    costs = [min(c for _, c, _ in _options(symbol, s, behind)) for s in range(4)]
    for _ in range(4):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


class Tables:
    """Normalised vectors, their transitions for each symbol and block, and the edits."""

    def __init__(self):
        first = tuple(c - min(FINAL) for c in FINAL)
        self.vectors, number = [first], {first: 0}
        one: list[list[int]] = []
        added: list[list[int]] = []
        for v in self.vectors:  # grows
            row, plus = [], []
            for symbol in range(10):
                costs = before(symbol, v)
                least = min(costs)
                normal = tuple(c - least for c in costs)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append(number[normal])
                plus.append(least)
            one.append(row)
            added.append(plus)
        self.one = one
        step, cost = np.array(one), np.array(added)
        codes = np.arange(10**BLOCK)
        at = np.repeat(np.arange(len(one))[:, None], len(codes), axis=1)
        total = np.zeros_like(at)
        for k in range(BLOCK):  # the last symbol of a block first
            digit = np.broadcast_to(codes // 10**k % 10, at.shape)
            total += cost[at, digit]
            at = step[at, digit]
        self.block, self.cost = at.tolist(), total.tolist()
        self.traced = [[[self._trace(v, x, s) for s in range(4)] for x in range(10)] for v in self.vectors]
        self.closing = [self._close(s) for s in range(4)]

    def _trace(self, behind: tuple, symbol: int, state: int) -> tuple[str, int]:
        """Edits in front of and at a turn, and the state after it."""
        if symbol == 0:
            return "", state
        costs, letters = before(symbol, behind), ""
        while True:
            want = costs[state]
            done = {letter: after for letter, c, after in _options(symbol, state, behind) if c == want}
            if "D" not in done and INSERT + costs[NEXT[state]] == want:
                letters, state = letters + "I", NEXT[state]
                continue
            least = min(done)
            return letters + least, done[least]

    @staticmethod
    def _close(state: int) -> str:
        letters = ""
        while FINAL[state]:
            letters, state = letters + "I", NEXT[state]
        return letters

    def codes(self, symbols: str) -> list[int]:
        """Blocks of a piece, filled up in front."""
        filled = "0" * (-len(symbols) % BLOCK) + symbols
        return [int(filled[i:i + BLOCK]) for i in range(0, len(filled), BLOCK)]

    def back(self, symbols: str, vector: int) -> tuple[int, int]:
        """The normalised vector in front of a piece, and what it costs on top."""
        cost = 0
        for code in reversed(self.codes(symbols)):
            cost += self.cost[vector][code]
            vector = self.block[vector][code]
        return vector, cost

    def edits(self, symbols: str, vector: int, state: int) -> tuple[list[tuple[str, int]], int]:
        """(edits, state before them) of each turn of a piece, with the vector behind it and the state in
        front of it; and the state after the piece."""
        codes = self.codes(symbols)
        behind = [vector]
        for code in reversed(codes[1:]):
            behind.append(self.block[behind[-1]][code])
        out = []
        for code, v in zip(codes, reversed(behind)):
            inner, block = [v], f"{code:0{BLOCK}d}"
            for x in reversed(block[1:]):  # expanded backward
                inner.append(self.one[inner[-1]][int(x)])
            for x, w in zip(block, reversed(inner)):
                letters, after = self.traced[w][int(x)][state]
                if x != "0":
                    out.append((letters, state))
                state = after
        return out, state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _symbol(fault: Column, initial: Column) -> Column:
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(fault.isin(BLANK, DUPLICATE), 1).otherwise(2 + 2 * role + F.when(fault == CUT, 1).otherwise(0))


def _vectors_behind(batches):
    """Pieces of a conversation from its last to its first: adds the vector behind each."""
    t, current, vector = tables(), None, 0
    for batch in batches:
        keys = batch.column("key").to_pylist()
        out = []
        for key, symbols in zip(keys, batch.column("symbols").to_pylist()):
            if key != current:
                current, vector = key, 0
            out.append(vector)
            vector, _ = t.back(symbols, vector)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())],
                                         names=[*batch.schema.names, "vector"])


_EDITS = "key string, edit string, role string, text string, fault int, turn long, was string"
_BATCH_CHARS = 4_000_000


def _edited(batches):
    """Conversations in order, each piece's symbols before its turns: a row for each edit."""
    t = tables()
    names = ["key", "edit", "role", "text", "fault", "turn", "was"]
    kinds = [pa.string()] * 4 + [pa.int32(), pa.int64(), pa.string()]
    current, state, waiting, faults = None, NONE, iter(()), iter(())
    rows, size = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)

    def inserted(letters, s):
        for _ in range(letters.count("I")):
            s = NEXT[s]
            rows.append((current, "I", NAMES[s], "", None, None, None))
        return s

    for batch in batches:
        for key, turn, role, text, symbols, marks, vector in zip(*(c.to_pylist() for c in batch.columns)):
            if key != current:
                inserted(t.closing[state], state)
                current, state = key, NONE
            if symbols is not None:
                edits, state = t.edits(symbols, vector, state)
                waiting, faults = iter(edits), iter(marks)
                continue
            letters, s = next(waiting)
            s = inserted(letters, s)
            last = letters[-1]
            kept = None if last == "D" else role if last == "K" else NAMES[NEXT[s]]
            rows.append((key, last, kept, None if last == "D" else text, int(next(faults)), turn, role))
            size += len(text)
            if size > _BATCH_CHARS or len(rows) > 20_000:
                yield flush()
                rows, size = [], 0
    inserted(t.closing[state], state)
    if rows:
        yield flush()


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """A row for each edit of the cheapest repair, in order within a partition: `key` (the conversation, see
    `conversation_key`), `edit` (K, R, D or I), the repaired `role` and `text` (null if deleted),
    `fault` (0 none, 1 blank, 2 role and text seen earlier, 3 truncated; null if inserted), the row's
    `turn` and its role before (`was`).

    Turns go by `turn` (null first), ties by role and text, so equal rows follow one another. Null
    roles and texts are one space; rows with a null conversation make up one conversation; roles
    count by their first character, and one that is none of s, u, a (or empty) must go or be changed.
    An empty table stays empty; other columns are not looked at.

    Turns are ordered over all partitions by ranges of (conversation, turn, role, text), so a very
    long conversation is sorted by many tasks; repeated turns are found by counts of digests. A
    conversation is then streamed through one task, twice: its symbols from the end, a byte a turn, and
    its turns from the start. A task holds the edits of one piece and one batch.
    """
    space = F.lit(" ")
    rows = turns.select(
        conversation_key(F.col(conv_id)).alias("key"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
    )
    by = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ordered = written(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("n", F.monotonically_increasing_id()), "turns"
    )
    said = F.rtrim("text", F.lit(SPACES))
    marked = ordered.select(
        "key", "n", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).alias("mark"),
        F.substring("role", 1, 1).alias("initial"), (said == "").alias("blank"),
        (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    repeats = marked.groupBy("key", "mark").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    judged = marked.join(repeats.drop("times"), ["key", "mark"], "left").select(
        "key", "n", "initial",
        F.when(F.col("blank"), BLANK).when(F.col("first") < F.col("n"), DUPLICATE).when(F.col("cut"), CUT).otherwise(0).alias("fault"),
    )
    each = F.sort_array(F.collect_list(F.struct("n", _symbol(F.col("fault"), F.col("initial")).alias("x"), "fault")))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("each", lambda e: e[field].cast("string")), "")

    pieces = (  # at most 2 ** PIECE_BITS turns each
        judged.groupBy("key", F.shiftright("n", PIECE_BITS).alias("piece")).agg(each.alias("each"))
        .select("key", F.get("each", F.lit(0))["n"].alias("n"), joined("x").alias("symbols"), joined("fault").alias("faults"))
        .repartition("key").sortWithinPartitions("key", F.col("n").desc())
        .mapInArrow(_vectors_behind, "key string, n long, symbols string, faults string, vector int")
    )
    none = F.lit(None)
    stream = ordered.select(
        "key", "n", F.lit(1).alias("kind"), "turn", "role", "text", none.cast("string").alias("symbols"),
        none.cast("string").alias("faults"), none.cast("int").alias("vector"),
    ).unionByName(pieces.select(
        "key", "n", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
        none.cast("string").alias("text"), "symbols", "faults", "vector",
    ))
    return (
        stream.repartition("key").sortWithinPartitions("key", "n", "kind")
        .select("key", "turn", "role", "text", "symbols", "faults", "vector").mapInArrow(_edited, _EDITS)
    )


def conversation_key(conv_id: Column) -> Column:
    """Text that stands for a conversation, null ones too."""
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


class _Summary:
    def __init__(self, key):
        self.key, self.audit, self.text, self.cost = key, [], hashlib.sha256(), 0
        self.faults, self.illegal, self.last, self.some = [0] * 4, 0, None, False
        self.low = self.high = None
        self.distinct = 0

    def add(self, edit, role, text, fault, turn, was):
        self.audit.append(edit)
        if edit != "D":
            self.text.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.some = True
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit == "I":
            return
        self.cost += TRUNCATED * (fault == CUT and edit != "D")
        self.faults[fault] += 1
        initial = was[:1]
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self):
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.key, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, self.cost,
                "".join(self.audit), self.text.hexdigest())


def _summaries(batches):
    names = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.string()] + [pa.int64()] * 6 + [pa.string()] * 2
    held, done = None, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*done), kinds)], names=names)

    for batch in batches:
        for key, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held.key != key:
                if held is not None:
                    done.append(held.row())
                held = _Summary(key)
            held.add(*rest)
        if done:
            yield flush()
            done = []
    if held is not None:
        done = [held.row()]
        yield flush()


def audit(edits: DataFrame, conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """A row for each id in `conversations`: what was wrong, the cost, the letters of the edits and a digest of
    the repaired `role:text` lines. `edits` as `repair` gives them, in order; ids without turns get zeros,
    no letters and the digest of the empty text."""
    found = edits.mapInArrow(
        _summaries,
        "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string",
    )
    ids = conversations.select(F.col(conv_id).alias("conv_id")).distinct().withColumn("key", conversation_key(F.col("conv_id")))
    zero = F.lit(0).cast("long")
    return ids.join(found, "key", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
