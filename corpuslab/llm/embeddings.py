"""Near-duplicate vectors by a robust-pruned flat graph.

Distinct vectors are dealt to overlapping clusters. In each cluster every vector gets a
robust-pruned list of neighbours; lists of vectors that stand in several clusters are united. Every
vector then searches the clusters nearest to it: greedy walks from the cluster's medoids come close
to it, and from what is near enough the search widens over neighbours for as long as they are in
range. Cosines of reported links are computed in double precision from the vectors themselves. Each
run's recall is audited against brute force, and more clusters are searched until it is high enough;
if it is not with all of them, every vector is compared with all members of all clusters in blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import components, row_map, written

#: Vectors a cluster is meant to have, clusters that hold a vector, clusters that a vector searches.
CLUSTER, OVERLAP, PROBES = 2000, 2, 5
#: Clusters with more members than this are dealt by hash to graphs of about half as many, and
#: their queries search each of these.
LARGEST = 8000
#: Vectors on which cluster centres are fitted at most, and clusters at most.
SAMPLE, MOST_CLUSTERS = 20_000, 4096
#: Neighbours kept by pruning, with the reverse ones at most, nearest and random candidates, and
#: how much nearer to a kept neighbour than to the vector itself makes a candidate redundant.
DEGREE, DEGREE_BOTH, NEAREST, RANDOM, ALPHA = 24, 64, 64, 24, 1.2
#: Medoids of a cluster, walks of a query, and how far below the threshold the search still widens.
MEDOIDS, WALKS, SLACK = 24, 4, 0.03
#: Queries that a task works on at once.
BLOCK = 256
#: Vectors of every how many'th id are audited, in blocks of about so many; of ids without such a
#: one, a block of all vectors is.
EVERY, AUDITED = 50, 2048
LEAST_RECALL = 0.9


# ---------------------------------------------------------------- in one cluster


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def medoids(x: np.ndarray, most: int = MEDOIDS) -> np.ndarray:
    """The vector nearest to the middle, then each time the one farthest from those taken."""
    taken = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[taken[0]]
    while len(taken) < min(most, len(x)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, x @ x[taken[-1]])
    return np.array(taken)


def pruned_lists(x: np.ndarray) -> np.ndarray:
    """Robust-pruned neighbours of each unit vector (rows of positions, -1 where there are fewer)."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1, dtype=np.int32)
    rng = np.random.default_rng(n)
    out = np.full((n, DEGREE), -1, dtype=np.int32)
    for start in range(0, n, 512):
        own = np.arange(start, min(n, start + 512))
        sims = x[own] @ x.T
        sims[np.arange(len(own)), own] = -2
        k = min(NEAREST, n - 1)
        cand = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        cand = np.concatenate([cand, rng.integers(0, n, (len(own), RANDOM))], axis=1)
        near = np.take_along_axis(sims, cand, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, axis=1), np.take_along_axis(near, order, axis=1)
        alive = cand != own[:, None]
        reach = np.sqrt(np.maximum(0, 2 - 2 * near))
        rows = np.arange(len(own))
        points = x[cand]
        for d in range(DEGREE):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            kept = cand[rows, first]
            out[own[some], d] = kept[some]
            apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nkd,nd->nk", points, x[kept])))
            alive &= ALPHA * apart > reach
            alive[rows, first] = False
    return out


def both_ways(forward: list[np.ndarray], n: int) -> np.ndarray:
    """Neighbour table with reverse edges: own neighbours first, at most `DEGREE_BOTH` in all."""
    source = np.repeat(np.arange(n), [len(f) for f in forward])
    target = np.concatenate([*forward, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    a, b = np.r_[source, target], np.r_[target, source]
    back = np.r_[np.zeros(len(source), dtype=np.int8), np.ones(len(source), dtype=np.int8)]
    order = np.lexsort((b, back, a))
    a, b = a[order], b[order]
    _, first = np.unique(a * n + b, return_index=True)
    first.sort()
    a, b = a[first], b[first]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < DEGREE_BOTH
    width = int(place[keep].max(initial=0)) + 1
    out = np.full((n, width), -1, dtype=np.int64)
    out[a[keep], place[keep]] = b[keep]
    return out


def in_range(raw: np.ndarray, lists: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float):
    """(query, member) positions of links found: `own` is a query's position among the members, or -1.

    Greedy walks from the best medoids, then widening over all that is in range (or nearly).
    """
    n = len(raw)
    size = np.linalg.norm(raw, axis=1)
    x = raw / size[:, None]
    starts = medoids(x)
    found_q, found_m = [], []
    for at in range(0, len(queries), BLOCK):
        q = queries[at:at + BLOCK]
        q_size = np.linalg.norm(q, axis=1)
        u = q / q_size[:, None]
        lane = np.repeat(np.arange(len(q)), min(WALKS, len(starts)))
        sims = u @ x[starts].T
        node = starts[np.argsort(-sims, axis=1, kind="stable")[:, :WALKS]].ravel()
        best = np.einsum("nd,nd->n", u[lane], x[node])
        moving = np.arange(len(lane))
        while len(moving):
            around = lists[node[moving]]
            s = np.einsum("nd,nkd->nk", u[lane[moving]], x[around])
            s[around < 0] = -2
            top = s.argmax(axis=1)
            better = s[np.arange(len(moving)), top] > best[moving] + 1e-12
            moving, around, top, s = moving[better], around[better], top[better], s[better]
            node[moving] = around[np.arange(len(moving)), top]
            best[moving] = s[np.arange(len(moving)), top]
        mine = np.flatnonzero(own[at:at + BLOCK] >= 0)
        seen = np.zeros((len(q), n), dtype=bool)
        close = best >= threshold - SLACK
        edge = np.unique(np.r_[lane[close] * n + node[close], mine * n + own[at:at + BLOCK][mine]])
        while len(edge):
            seen.flat[edge] = True
            by, to = np.divmod(edge, n)
            reach = np.zeros((len(q), n), dtype=bool)
            for column in lists.T:
                step = column[to]
                ok = step >= 0
                reach[by[ok], step[ok]] = True
            reach &= ~seen
            edge = np.flatnonzero(reach)
            by, to = np.divmod(edge, n)
            ok = np.zeros(len(edge), dtype=bool)
            for k in range(0, len(edge), 65536):
                part = slice(k, k + 65536)
                ok[part] = np.einsum("nd,nd->n", u[by[part]], x[to[part]]) >= threshold - SLACK
            edge = edge[ok]
        by, to = np.nonzero(seen)
        other = own[at:at + BLOCK][by] != to
        by, to = by[other], to[other]
        exact = np.empty(len(by))
        for k in range(0, len(by), 65536):
            part = slice(k, k + 65536)
            exact[part] = np.einsum("nd,nd->n", q[by[part]], raw[to[part]]) / (q_size[by[part]] * size[to[part]])
        hit = exact >= threshold
        found_q.append(by[hit] + at)
        found_m.append(to[hit])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *found_q]), np.concatenate([none, *found_m])


def in_blocks(raw: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float):
    """(query, member) positions of all links, as `in_range`, by comparing each query with each member."""
    size = np.linalg.norm(raw, axis=1)
    found_q, found_m = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(queries), BLOCK):
        q = queries[at:at + BLOCK]
        q_size = np.linalg.norm(q, axis=1)
        by, to = np.nonzero((q @ raw.T) / (q_size[:, None] * size) >= threshold - 1e-9)
        other = own[at:at + BLOCK][by] != to
        by, to = by[other], to[other]
        for k in range(0, len(by), 65536):
            b, t = by[k:k + 65536], to[k:k + 65536]
            hit = np.einsum("nd,nd->n", q[b], raw[t]) / (q_size[b] * size[t]) >= threshold
            found_q.append(b[hit] + at)
            found_m.append(t[hit])
    return np.concatenate(found_q), np.concatenate(found_m)


# ---------------------------------------------------------------- over all


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """`node`, `v`, `first_id`, `copies`, `audited` of the distinct usable vectors of `id`, `v`."""
    usable = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable &= F.exists("v", lambda x: x != 0)
    distinct = rows.where(F.col("v").isNotNull() & usable).groupBy("v").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
        F.max(F.coalesce(F.col("id") % EVERY == 0, F.lit(False))).alias("audited"),
    )
    return written(distinct.select(F.monotonically_increasing_id().alias("node"), "v", "first_id", "copies", "audited"), "vectors")


def centres(nodes: DataFrame, dimension: int, count: int) -> np.ndarray:
    """Unit cluster centres, fitted on at most `SAMPLE` vectors (those with the smallest hashes)."""
    k = min(MOST_CLUSTERS, max(1, -(-count // CLUSTER)))
    if k == 1:
        return np.ones((1, dimension)) / np.sqrt(dimension)
    rows = nodes.where(F.size("v") == dimension).orderBy(F.xxhash64("v"), "node").limit(SAMPLE).select("v").collect()
    x = unit(np.array([r[0] for r in rows], dtype=np.float64))
    k = min(k, len(x))
    c = x[np.random.default_rng(3).permutation(len(x))[:k]]
    for _ in range(8):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def _dealt(nodes: DataFrame, by_size: dict[int, np.ndarray], probes: int) -> DataFrame:
    """Adds `homes` (clusters that hold the vector) and `probes` (those it searches), nearest first.
    Cluster numbers of different dimensions do not meet."""
    shared = nodes.sparkSession.sparkContext.broadcast(by_size)
    base, offset = {}, 0
    for d in sorted(by_size):
        base[d] = offset
        offset += len(by_size[d])

    def make():
        def run(cols):
            homes, probed = [None] * len(cols["v"]), [None] * len(cols["v"])
            lengths = np.array([len(v) for v in cols["v"]])
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                c = shared.value[d]
                for part in np.array_split(rows, max(1, len(rows) * len(c) // 4_000_000)):
                    near = np.argsort(-(unit(np.array([cols["v"][i] for i in part], dtype=np.float64)) @ c.T), axis=1,
                                      kind="stable")[:, : max(OVERLAP, probes)] + base[d]
                    for i, r in zip(part.tolist(), near):
                        homes[i], probed[i] = r[:OVERLAP].tolist(), r[:probes].tolist()
            return {k: cols[k] for k in ("node", "v", "copies")} | {"homes": homes, "probes": probed}

        return run

    kind = nodes.schema["v"].dataType.simpleString()
    return row_map(nodes.select("node", "v", "copies"), make, f"node long, v {kind}, copies long, homes array<int>, probes array<int>")


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    x = unit(np.array(pdf["v"].tolist(), dtype=np.float64))
    ids = pdf["node"].to_numpy()
    lists = pruned_lists(x)
    return pd.DataFrame({"node": ids, "near": [ids[r[r >= 0]].tolist() for r in lists]})


def _search(threshold: float, exact: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members = pdf[pdf["member"]].drop_duplicates("node")
        queries = pdf[~pdf["member"]]
        empty = pd.DataFrame({"node": [], "links": [], "other": []}).astype("int64")
        if not len(members) or not len(queries):
            return empty
        cluster = int(pdf["cluster"].iloc[0])
        ids = members["node"].to_numpy()
        order = np.argsort(ids)
        members, ids = members.iloc[order], ids[order]
        n = len(ids)
        raw = np.array(members["v"].tolist(), dtype=np.float64)

        def position(wanted):
            at = np.minimum(np.searchsorted(ids, wanted), n - 1)
            return np.where(ids[at] == wanted, at, -1)

        forward = []
        for near in members["near"]:
            at = position(np.asarray(near, dtype=np.int64))
            forward.append(at[at >= 0])
        query_ids = queries["node"].to_numpy()
        own = position(query_ids)
        asked = np.array(queries["v"].tolist(), dtype=np.float64)
        if exact:
            by, to = in_blocks(raw, asked, own, threshold)
        else:
            by, to = in_range(raw, both_ways(forward, n), asked, own, threshold)
        # a pair is counted in the member's first home that the query searches
        homes = np.array([[h[0], h[-1]] for h in members["homes"]])
        probes = queries["probes"].tolist()
        first_seen = np.fromiter((homes[m, 0] in probes[q] for q, m in zip(by, to)), dtype=bool, count=len(by))
        counted = np.where(first_seen, homes[to, 0], homes[to, 1]) == cluster
        links = np.bincount(by[counted], weights=members["copies"].to_numpy()[to[counted]], minlength=len(queries))
        # enough edges to connect what is linked: members and queries that are not members
        label = np.arange(n + len(queries))
        at = np.where(own >= 0, own, n + np.arange(len(queries)))
        ends = np.searchsorted(by, np.arange(len(queries) + 1))
        for q in np.flatnonzero(np.diff(ends)):
            met = np.unique(np.r_[label[to[ends[q]:ends[q + 1]]], label[at[q]]])
            if len(met) > 1:
                label[np.isin(label, met[1:])] = met[0]
        named = np.r_[ids, query_ids]
        order = np.argsort(label, kind="stable")
        same = np.flatnonzero(label[order[1:]] == label[order[:-1]])
        some = np.flatnonzero(links)
        return pd.DataFrame({
            "node": np.r_[query_ids[some], named[order[same]]],
            "links": np.r_[links[some].astype(np.int64), np.zeros(len(same), dtype=np.int64)],
            "other": np.r_[np.full(len(some), -1), named[order[same + 1]]],
        })

    return run


def _found(nodes: DataFrame, by_size: dict[int, np.ndarray], threshold: float, probes: int,
           exact: bool = False) -> DataFrame:
    """Rows `node`, `links` (with `other` -1) and edges `node`, `other` (with `links` 0)."""
    dealt = written(_dealt(nodes, by_size, probes), "dealt")
    held = dealt.select("node", "v", "copies", "homes", F.explode("homes").alias("cluster"))
    sizes = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("cluster", F.when(F.col("n") > LARGEST, F.ceil(F.col("n") * 2 / LARGEST)).otherwise(1).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    held = held.join(sizes, "cluster").withColumn("part", part)
    lists = held.select("cluster", "part", "node", "v").groupBy("cluster", "part").applyInPandas(_graph, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    united = written(united, "graph")
    # queries come in lots, so that no task has all of a large cluster
    lot = F.pmod(F.xxhash64("node", F.lit("lot")), F.col("parts")).cast("int")
    none = F.lit(None)
    queries = dealt.select("node", "v", "copies", "homes", "probes", F.explode("probes").alias("cluster")).join(sizes, "cluster").select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), lot.alias("lot"), "node", "v",
        "copies", "homes", "probes", none.cast("array<long>").alias("near"), F.lit(False).alias("member"),
    )
    members = held.join(united, "node").select(
        "cluster", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("lot"), "node", "v",
        "copies", "homes", none.cast("array<int>").alias("probes"), "near", F.lit(True).alias("member"),
    )
    return written(
        members.unionByName(queries).groupBy("cluster", "part", "lot")
        .applyInPandas(_search(threshold, exact), "node long, links long, other long"), "links",
    )


def audit(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Mean share of its links that `found` has of each vector that has links, over the vectors to be
    audited, against brute force over all vectors. 1 where none has a link."""
    asked = nodes.where("audited")
    count = asked.count()
    if not count:
        asked = nodes.orderBy(F.xxhash64("v", F.lit("audit")), "node").limit(AUDITED)
    blocks = max(1, -(-count // AUDITED))
    got = found.where("other = -1").groupBy("node").agg(F.sum("links").alias("g"))
    vectors, total = 0, 0.0
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(blocks)) == k) if blocks > 1 else asked
        rows = block.select("node", "v").collect()
        if not rows:
            continue
        truth = _true_links(nodes, np.array([r[0] for r in rows]), [np.array(r[1], dtype=np.float64) for r in rows], threshold)
        share = F.least("t", F.coalesce("g", F.lit(0))) / F.col("t")
        n, shares = truth.where("t > 0").join(got, "node", "left").agg(F.count(F.lit(1)), F.sum(share)).first()
        vectors, total = vectors + n, total + (shares or 0.0)
    return total / vectors if vectors else 1.0


def _true_links(nodes: DataFrame, ids: np.ndarray, vectors: list[np.ndarray], threshold: float) -> DataFrame:
    """`node`, `t`: links of each of `vectors` with the vectors of other nodes, by brute force."""

    def make():
        def run(cols):
            total = np.zeros(len(ids), dtype=np.int64)
            lengths = np.array([len(v) for v in cols["v"]])
            for d in {len(v) for v in vectors}:
                rows, mine = np.flatnonzero(lengths == d), [i for i, v in enumerate(vectors) if len(v) == d]
                if not len(rows):
                    continue
                q = np.array([vectors[i] for i in mine])
                for part in np.array_split(rows, -(-len(rows) // 1024)):
                    x = np.array([cols["v"][i] for i in part], dtype=np.float64)
                    c = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None])
                    near = (c >= threshold) & (ids[mine][:, None] != np.array(cols["node"])[part][None])
                    total[mine] += near @ np.array(cols["copies"])[part]
            return {"node": ids, "links": total}

        return run

    return row_map(nodes.select("node", "v", "copies"), make, "node long, links long").groupBy("node").agg(F.sum("links").alias("t"))


def near_vectors(rows: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding",
                 probes: int = PROBES, least_recall: float = LEAST_RECALL) -> DataFrame:
    """One row per vector: `vec_id`, `n_links` (other vectors at a cosine of `threshold` or more),
    `component_id` (smallest id reachable over links, itself included), `kept` (it is that one).

    Null, empty and zero vectors and those with null or non-finite components link with nothing;
    nor do vectors of different lengths. Equal vectors are one node of the graph and link with each
    other. A null id never is a component's; a component of null ids only has a null one, and
    keeps its rows. Repeated rows are vectors of their own; an empty table stays empty.
    """
    base = rows.select(
        F.col(vec_id).cast("long").alias("id"), F.transform(F.col(embedding), lambda x: x + F.lit(0).cast("float")).alias("v")
    )
    nodes = distinct_vectors(base)
    sizes = {r[0]: r[1] for r in nodes.groupBy(F.size("v")).count().collect()}
    by_size = {d: centres(nodes, d, n) for d, n in sizes.items()}
    most = max([len(c) for c in by_size.values()], default=1)
    exact = False
    while True:
        found = _found(nodes, by_size, threshold, probes, exact) if sizes else None
        if found is None or exact or audit(nodes, found, threshold) >= least_recall:
            break
        exact, probes = probes >= most, min(most, 2 * probes)
    if found is None:
        return base.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.where("other = -1").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other >= 0"), "node", "other").withColumnRenamed("node", "member")
    joined = nodes.join(roots, F.col("node") == F.col("member"), "left").join(counts, "node", "left").select(
        "v", "first_id", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    joined = written(joined, "components")
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = joined.join(smallest, "root").select(F.col("v").alias("w"), "n_links", "component_id")
    out = base.join(known, F.col("v") == F.col("w"), "left")
    component = F.when(F.col("w").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
