"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins what its own bucket says (a learned vector, and how much oftener toxic texts
have it), and the same of its character 4-grams, so that unseen forms of a word are recognised. Two
gated recurrent layers read the words in both directions, attention pools their states over a window
of `WINDOW` words, and one unit gives the window's logit. All overlapping windows are scored, one from
each word: they share the words' states, which are run once over spans of `SPAN` words with `WARM` words
of context at their ends, and running sums of attention give each window its pooled state. A text's logit
is the largest of its windows, which a logistic curve fitted on texts kept out of the network's training
turns into a probability.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import crc_fold, kept, row_map

WINDOW = 48
#: Words whose states are run together, and words of context before and after them.
SPAN, WARM = 96, 16
BUCKETS, VECTOR, STATES = 1 << 14, 6, 8
INPUTS = 3 + 2 * VECTOR
#: Labelled texts to learn from at most, of each class; all windows of each count. The bounds hold
#: however many labels there are.
TOXIC_SAMPLE, CLEAN_SAMPLE = 1200, 3600
#: Attention scores beyond this, up or down, count as this.
STEEPEST = 15.0
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Words whose inputs are made together in training, and a hundred times the texts scored together.
PART = 20_000
#: Words a worker remembers; when there are more, it starts again with none.
MEMORY = 200_000
#: The fold of four that is never learned from.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3

_EDGES = re.compile(r"^\W+|\W+$")


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words: the bucket of each, the buckets of their character 4-grams one after another, and
    where each word's 4-grams start. Case and punctuation at the ends do not count."""
    own, grams, starts = np.zeros(len(words), dtype=np.int64), [], np.zeros(len(words), dtype=np.int64)
    crc, mask = zlib.crc32, BUCKETS - 1
    for i, w in enumerate(words):
        body = w.lower()
        if not body.isalpha():
            body = _EDGES.sub("", body)
        b = f"<{body}>".encode()
        own[i] = crc(b) & mask
        starts[i] = len(grams)
        grams += [crc(b[k:k + 4]) & mask for k in range(max(1, len(b) - 3))]
    return own, np.array(grams, dtype=np.int64), starts


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters, and the forward and backward passes over batches of windows."""

    NAMES = ("word", "char", "w", "u", "b", "v", "o", "c")

    def __init__(self, word_rate: np.ndarray, char_rate: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.word_rate, self.char_rate = word_rate.astype(np.float32), char_rate.astype(np.float32)
        self.word, self.char = normal(BUCKETS, VECTOR, scale=0.05), normal(BUCKETS, VECTOR, scale=0.05)
        self.w = normal(2, INPUTS, 3 * STATES, scale=0.3)
        self.u = normal(2, STATES, 3 * STATES, scale=0.3)
        self.b = np.zeros((2, 1, 3 * STATES), dtype=np.float32)
        self.v = normal(2 * STATES, scale=0.3)
        self.o = normal(2 * STATES, scale=0.3)
        self.c = np.zeros(1, dtype=np.float32)
        self.curve = np.array([1.0, 0.0])

    def inputs(self, own, grams, starts) -> np.ndarray:
        """The input vector of each word."""
        if not len(own):
            return np.zeros((0, INPUTS), dtype=np.float32)
        counts = np.diff(np.r_[starts, len(grams)])[:, None]
        rates = self.char_rate[grams]
        return np.concatenate([
            self.word_rate[own][:, None], np.maximum.reduceat(rates, starts)[:, None],
            np.add.reduceat(rates, starts)[:, None] / counts, self.word[own],
            np.add.reduceat(self.char[grams], starts) / counts,
        ], axis=1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        return np.matmul(x[None], self.w) + self.b

    def states(self, gates: np.ndarray, at: np.ndarray, filled: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States of both directions by place and row. `at`: rows of `gates` by row and place; `filled`: where
        a word is."""
        n, t = at.shape
        s = STATES
        h = np.zeros((2, n, s), dtype=np.float32)
        both = np.empty((t, n, 2 * s), dtype=np.float32)  # place, row, state
        g = np.empty((2, n, 3 * s), dtype=np.float32)
        for i in range(t):
            j = t - 1 - i
            np.take(gates[0], at[:, i], axis=0, out=g[0])
            np.take(gates[1], at[:, j], axis=0, out=g[1])
            gh = np.matmul(h, self.u)
            zr = _sigmoid(g[..., :2 * s] + gh[..., :2 * s])
            z, r = zr[..., :s], zr[..., s:]
            new = np.tanh(g[..., 2 * s:] + r * gh[..., 2 * s:])
            mask = np.stack([filled[:, i], filled[:, j]])[..., None]
            if trace is not None:
                trace.append((h, z, r, new, gh[..., 2 * s:], mask))
            h = (new + z * (h - new)) * mask
            both[i, :, :s], both[j, :, s:] = h
        return both

    def forward(self, gates: np.ndarray, at: np.ndarray, filled: np.ndarray, core: np.ndarray, keep: bool = False):
        """Logits of windows, each a row of places. `core`: the places that are pooled; others are context."""
        trace: list = []
        both = self.states(gates, at, filled, trace if keep else None)
        score = np.where(core.T, both @ self.v, np.float32(-1e9))
        score = np.exp(score - score.max(axis=0))
        weight = (score / score.sum(axis=0) * core.T).astype(np.float32)
        pooled = (weight[..., None] * both).sum(axis=0)
        logit = pooled @ self.o + self.c
        return (logit, trace, both, weight, pooled) if keep else logit

    def backward(self, d_logit, at, filled, trace, both, weight, pooled, rows: int):
        """Gradients of `w` inputs' gates (by row), `u`, `v`, `o`, `c`."""
        s, (n, t) = STATES, at.shape
        grad = {"o": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True), "u": np.zeros_like(self.u)}
        d_pooled = d_logit[:, None] * self.o
        d_weight = np.einsum("nk,tnk->tn", d_pooled, both)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["v"] = np.einsum("tn,tnk->k", d_score, both)
        d_both = weight[..., None] * d_pooled + d_score[..., None] * self.v
        d_state = np.stack([d_both[..., :s], d_both[::-1, :, s:]], axis=1)  # step, direction, window, state
        d_gates = np.zeros((2, rows, 3 * s), dtype=np.float32)
        dh = np.zeros((2, n, s), dtype=np.float32)
        for i in reversed(range(t)):
            h, z, r, new, gh_new, mask = trace[i]
            dh = (dh + d_state[i]) * mask
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * gh_new * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_new], axis=-1)
            d_gh = np.concatenate([d_z, d_r, d_new * r], axis=-1)
            grad["u"] += np.matmul(h.transpose(0, 2, 1), d_gh)
            np.add.at(d_gates[0], at[:, i], d_g[0])
            np.add.at(d_gates[1], at[:, t - 1 - i], d_g[1])
            dh = dh * z + np.matmul(d_gh, self.u.transpose(0, 2, 1))
        return grad, d_gates


class Windows:
    """Words of many texts as rows of a table, and windows over them."""

    def __init__(self, network: Network):
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.gates = np.zeros((2, 1, 3 * STATES), dtype=np.float32)  # row 0: no word
        self.used = 1

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.rows]
        if not new:
            return
        if self.used + len(new) > MEMORY and len(self.rows):
            self.clear()
            new = list(words)
        gates = self.network.gates(self.network.inputs(*word_buckets(new)))
        if self.used + len(new) > self.gates.shape[1]:
            room = np.zeros((2, max(2 * self.gates.shape[1], self.used + len(new)), 3 * STATES), dtype=np.float32)
            room[:, : self.used] = self.gates[:, : self.used]
            self.gates = room
        self.gates[:, self.used:self.used + len(new)] = gates
        self.rows.update(zip(new, range(self.used, self.used + len(new))))
        self.used += len(new)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each whole text."""
        split = [t.split() if t else [] for t in texts]
        self.learn(set().union(*split))
        row = self.rows.__getitem__
        return best_windows(self.network, self.gates, [np.fromiter(map(row, ws), dtype=np.int32, count=len(ws)) for ws in split])[0]


def _windows(name: str, shared) -> Windows:
    return kept(("toxicity", name), lambda: Windows(shared.value))


def laid_out(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' rows of words as spans with context: rows by span and place (0 where no word is), how many
    places have words, the place of the first word that is not context, and that word's number among all
    words of the texts."""
    width = SPAN + 2 * WARM
    pieces, used, first, number, before = [], [], [], [], 0
    for words in rows:
        count = -(-len(words) // SPAN)
        if count:
            padded = np.zeros((count - 1) * SPAN + width, dtype=np.int32)
            padded[: len(words)] = words
            at = np.maximum(np.arange(count) * SPAN - WARM, 0)
            pieces.append(np.lib.stride_tricks.sliding_window_view(padded, width)[at])
            used.append(np.minimum(len(words) - at, width))
            first.append(np.arange(count) * SPAN - at)
            number.append(before + np.arange(count) * SPAN)
        before += len(words)
    if not pieces:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros((0, width), dtype=np.int32), none, none, none
    return np.concatenate(pieces), np.concatenate(used), np.concatenate(first), np.concatenate(number)


def best_windows(network: Network, gates: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The largest logit of each text's windows, and the word at which that window starts (the first of equals)."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    at, used, first, number = laid_out(rows)
    values = np.zeros((int(sizes.sum()), 2))  # attention score and logit of each word
    ends = np.stack([network.v, network.o], axis=1)
    order = np.argsort(used, kind="stable")  # short ones together, so few places are empty
    for i in range(0, len(order), 2048):
        pick = order[i:i + 2048]
        t = int(used[pick[-1]])
        part = at[pick, :t]
        both = network.states(gates, part, part > 0) @ ends
        place = np.arange(t)[None]
        core = (place >= first[pick, None]) & (place < np.minimum(first[pick] + SPAN, used[pick])[:, None])
        word = number[pick, None] + place - first[pick, None]
        values[word[core]] = both.transpose(1, 0, 2)[core]
    weight = np.exp(np.clip(values[:, 0], -STEEPEST, STEEPEST))
    logits, starts = np.full(len(rows), float(network.c[0])), np.zeros(len(rows), dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for k in np.flatnonzero(sizes):
        w = weight[begin[k]:begin[k + 1]]
        up = np.concatenate([[0.0], np.cumsum(w * values[begin[k]:begin[k + 1], 1])])
        down = np.concatenate([[0.0], np.cumsum(w)])
        n = min(WINDOW, len(w))
        pooled = (up[n:] - up[:-n]) / (down[n:] - down[:-n])
        starts[k] = pooled.argmax()
        logits[k] += pooled[starts[k]]
    return logits, starts


def around(words: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """A window's rows with its context, and which places are the window's own."""
    a = max(0, start - WARM)
    row = np.zeros(WINDOW + 2 * WARM, dtype=np.int32)
    part = words[a:start + WINDOW + WARM]
    row[: len(part)] = part
    core = np.zeros(len(row), dtype=bool)
    core[start - a:min(start + WINDOW, len(words)) - a] = True
    return row, core


def _rates(texts: list[list[str]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the number of toxic texts that have a bucket exceeds what is expected, in deviations."""
    counts = np.zeros((2, 2, BUCKETS))
    for text, y in zip(texts, labels):
        words = list(set(text))
        if words:
            own, grams, _ = word_buckets(words)
            counts[0, y][np.unique(own)] += 1
            counts[1, y][np.unique(grams)] += 1
    share = labels.mean()
    expected = counts.sum(axis=1) * share
    z = (counts[:, 1] - expected) / np.sqrt(expected + 1)
    return tuple(np.clip(z / 8, -1, 1))


def train(texts: list[list[str]], labels: np.ndarray, share: float | None = None) -> Network:
    """Learns from texts, given as words. `share`: how many of all labelled texts are toxic, where
    the given ones are not a fair sample. Without a toxic or a clean text all scores are `share`."""
    labels = np.asarray(labels, dtype=np.int64)
    share = float(np.clip(labels.mean() if share is None and len(labels) else share or 0.0, 1e-3, 1 - 1e-3))
    if len(set(labels.tolist())) < 2:
        network = Network(np.zeros(BUCKETS), np.zeros(BUCKETS))
        network.curve = np.array([0.0, np.log(share / (1 - share))])
        return network
    order = np.random.default_rng(11).permutation(len(texts))
    fit, check = order[len(order) // 4:], order[: len(order) // 4]
    if len(set(labels[fit].tolist())) < 2:
        fit = order
    network = Network(*_rates([texts[i] for i in fit], labels[fit]))

    words = sorted(set().union(*texts))
    number = {w: i + 1 for i, w in enumerate(words)}
    own, grams, starts = word_buckets(words)
    ends = np.r_[starts[1:], len(grams)]
    rows = [np.array([number[w] for w in t], dtype=np.int32) for t in texts]

    def best(of):
        gates = np.zeros((2, len(words) + 1, 3 * STATES), dtype=np.float32)
        for a in range(0, len(words), PART):
            b = min(a + PART, len(words))
            x = network.inputs(own[a:b], grams[starts[a]:ends[b - 1]], starts[a:b] - starts[a])
            gates[:, a + 1:b + 1] = network.gates(x)
        logits, at = zip(*[best_windows(network, gates, [rows[i] for i in of[k:k + PART // 100]]) for k in range(0, len(of), PART // 100)])
        return np.concatenate(logits), np.concatenate(at)

    moments = {k: [np.zeros_like(getattr(network, k)) for _ in range(2)] for k in Network.NAMES}
    rng, step = np.random.default_rng(5), 0
    heavier = (labels[fit] == 0).sum() / max(1, (labels[fit] == 1).sum())
    for epoch in range(EPOCHS):
        pieces = [around(rows[i], int(at)) for i, at in zip(fit, best(fit)[1])]
        top, cores = (np.array(x) for x in zip(*pieces))
        y = labels[fit].astype(np.float32)
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // BATCH)):
            at, filled, core = top[part], top[part] > 0, cores[part]
            met, inverse = np.unique(at, return_inverse=True)
            inverse = inverse.reshape(at.shape)
            real = met[met > 0] - 1
            pad = len(met) - len(real)
            lengths = ends[real] - starts[real]
            flat = np.concatenate([grams[starts[r]:ends[r]] for r in real]) if len(real) else np.zeros(0, dtype=np.int64)
            firsts = np.cumsum(np.r_[0, lengths[:-1]]) if len(real) else np.zeros(0, dtype=np.int64)
            x = np.concatenate([np.zeros((pad, INPUTS), np.float32), network.inputs(own[real], flat, firsts)])
            gates = network.gates(x)
            logit, trace, both, weight, pooled = network.forward(gates, inverse, filled, core, keep=True)
            weights = np.where(y[part] > 0, min(heavier, 4.0), 1.0).astype(np.float32)
            d = (weights * (_sigmoid(logit) - y[part]) / len(part)).astype(np.float32)
            grad, d_gates = network.backward(d, inverse, filled, trace, both, weight, pooled, len(met))
            grad["w"] = np.matmul(np.broadcast_to(x.T, (2, *x.T.shape)), d_gates)
            grad["b"] = d_gates.sum(axis=1, keepdims=True)
            d_x = np.matmul(d_gates, network.w.transpose(0, 2, 1)).sum(axis=0)[pad:]
            grad["word"], grad["char"] = np.zeros_like(network.word), np.zeros_like(network.char)
            np.add.at(grad["word"], own[real], d_x[:, 3:3 + VECTOR])
            np.add.at(grad["char"], flat, np.repeat(d_x[:, 3 + VECTOR:] / np.maximum(1, lengths)[:, None], lengths, axis=0))
            step += 1
            for k, g in grad.items():
                value = getattr(network, k)
                g = g + 1e-4 * value
                m, q = moments[k]
                m += 0.1 * (g - m)
                q += 0.01 * (g * g - q)
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    seen = check if len(set(labels[check].tolist())) == 2 else order
    network.curve = _curve(best(seen)[0], labels[seen], share)
    return network


def _curve(logits: np.ndarray, labels: np.ndarray, share: float) -> np.ndarray:
    """Slope and shift of the logistic curve, for texts of which `share` are toxic."""
    mean = labels.mean()
    weight = np.where(labels == 1, share / mean, (1 - share) / (1 - mean))
    a = np.array([1.0, 0.0])
    x = np.stack([logits.astype(np.float64), np.ones(len(logits))], axis=1)
    for _ in range(50):  # Newton steps, slightly drawn to slope 1
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + 0.1 * (a - [1.0, 0.0])
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        a = a - np.clip(np.linalg.solve(bend, slope), -2, 2)
    return a


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Network:
    """Trains on a bounded sample of the labelled rows that are not held out.

    A text labelled both ways counts as toxic; null labels and ids are left out. The smallest
    hashes of ids make the sample, so it is the same wherever the rows lie. The sample's whole texts,
    bounded in number, come to the driver.
    """
    known = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (crc_fold("doc_id", FOLDS) != HELD_OUT))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    by_hash = F.xxhash64("doc_id", F.lit("toxicity"))
    sample = known.where("y = 1").orderBy(by_hash, "doc_id").limit(TOXIC_SAMPLE).unionAll(
        known.where("y = 0").orderBy(by_hash, "doc_id").limit(CLEAN_SAMPLE)
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id")  # at most TOXIC_SAMPLE + CLEAN_SAMPLE rows

    rows = joined.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    once: dict[str, str] = {}  # a word is held once, however often texts have it
    texts = [[once.setdefault(w, w) for w in (r["text"] or "").split()] for r in rows]
    known_labels = np.array([r["y"] for r in rows], dtype=np.int64)
    del rows
    total = sum(sizes.values())
    return train(texts, known_labels, sizes.get(1, 0) / total if total else None)


def score(docs: DataFrame, network: Network, keep: list[str] | None = None, doc_id: str = "doc_id",
          text: str = "text", name: str = "score") -> DataFrame:
    """`doc_id` (or the columns `keep`, which must have `text`) and `score` of each row's whole text, under
    `name`, which must not be one of them.

    Null, empty and blank texts score 0. Repeated rows are scored
    each; null ids stay null; an empty table stays empty.
    """
    if keep is None:
        source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        kept = ["doc_id"]
    else:
        source, kept = docs.select(*keep), keep
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*kept).schema)
    shared, learned = docs.sparkSession.sparkContext.broadcast(network), uuid.uuid4().hex

    def make():
        windows = _windows(learned, shared)

        def run(cols):
            a, b = shared.value.curve
            p = 1 / (1 + np.exp(-np.clip(a * windows.logits(cols["text"]).astype(np.float64) + b, -30, 30)))
            p[[not t or t.isspace() for t in cols["text"]]] = 0.0
            return {k: cols[k] for k in kept} | {name: p}

        return run

    return row_map(source, make, f"{ddl}, `{name}` double")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns and scores: `doc_id`, `held_out`, `score`, `predicted` for every row."""
    return score(docs, learn(docs, labels, doc_id, text), doc_id=doc_id, text=text).select(
        "doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
