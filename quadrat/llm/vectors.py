"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted by balanced k-means to a bounded sample, in two levels where there are many; every
distinct vector is indexed. The number of lists grows with the rows, ``LIST_ROWS`` a list, up to
``MAX_LISTS``; beyond that lists grow longer and all of a list is read. A vector
near a boundary is replicated to each cluster whose centroid is within ``(1 + REPLICATE)`` of its nearest
centroid's distance and not hidden behind a nearer chosen centroid. Centroids are searched by matrix products,
which at ``MAX_LISTS`` take a tenth of the time of a walk through a neighbour graph and no table of pairs. A query reads every list whose distance ratio to its
nearest centroid is at most ``1 + probe``; no number limits them. ``probe`` is ``PROBE`` or more: it is widened
until sampled queries find ``RECALL`` of their exact nearest.

Neighbouring lists are packed into groups of ``GROUP_ROWS`` vectors; a longer list is cut into blocks. A query travels
once to each group that holds lists it reads, with their numbers, and queries of a group are cut into
blocks of ``QUERY_ROWS``, so a task holds a bounded number of either. Every block returns its best 20, so merges stay small.

Vectors of different length are compared by inner product: distances use the reduction that adds one
coordinate, sqrt(max norm^2 - norm^2), after which nearest means largest inner product.

Equal vectors are stored once with their ``top + 1`` smallest ids, which is all that a top list can show.
Scores are sums in double precision from the first component to the last, the same for equal vectors.

Defined cases: null, zero or non-finite vectors and null ids take no part; vectors of another width than
most are ignored with them; repeated ids keep their rows' vectors apart and an id never finds itself; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrat.llm.shared import shuffle_width, staged

TOP, QUERY_STEP = 20, 20
SAMPLE, LIST_ROWS, MAX_LISTS = 65536, 96, 16384
#: Lists up to which k-means runs in one level, and vectors that one level is fitted to.
FLAT_LISTS, FLAT_SAMPLE = 640, 16384
REPLICATE, MAX_COPIES, PROBE, MIN_LISTS = 0.10, 4, 0.22, 12
GROUP_ROWS, QUERY_ROWS = 8192, 2048
#: Queries whose exact nearest set the probe, and the share of these that its lists must hold (0.9 is asked for).
TRIALS, RECALL = 256, 0.95


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles)."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(good & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def distinct_vectors(rows: DataFrame, top: int = TOP) -> DataFrame:
    """key, v, ids (the top + 1 smallest). Tasks merge their own copies first, so a hot vector stays small."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            for at in range(0, len(items), 4096):
                part = items[at : at + 4096]
                v = pa.array([np.frombuffer(k) for k, _ in part], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([v, pa.array([sorted(set(i))[: top + 1] for _, i in part], pa.list_(pa.int64()))], names=["v", "ids"])
            seen.clear()

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = seen.setdefault((np.array(v.values.to_numpy(zero_copy_only=False), float) + 0.0).tobytes(), [])
                ids.append(i)
                if len(ids) > 4096:
                    ids[:] = sorted(set(ids))[: top + 1]
            if len(seen) > 200_000:
                yield from out()
        yield from out()

    part = rows.select("vec_id", "v").mapInArrow(merge, "v array<double>, ids array<long>")
    whole = part.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top + 1).alias("ids"))
    return whole.select(F.xxhash64("v").alias("key"), "v", "ids")


def balanced_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means whose distances carry a penalty for the size that a cluster has reached."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    load = np.zeros(k)
    for _ in range(rounds):
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]
        scale = np.median(d.min(1)) + 1e-12
        near = (d + scale * 0.25 * load[None]).argmin(1)
        count = np.bincount(near, minlength=k)
        load = 0.5 * load + 0.5 * (count / (len(x) / k) - 1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = count > 0
        c[full] = total[full] / count[full, None]
        for j in np.flatnonzero(~full):
            c[j] = x[rng.integers(len(x))]
    return c


def two_level_means(x: np.ndarray, k: int) -> np.ndarray:
    """Up to ``FLAT_LISTS`` centroids directly; more as centroids of the cells of a coarse level, in cell order."""
    if k <= FLAT_LISTS:
        return balanced_means(x[:FLAT_SAMPLE], k)
    coarse = balanced_means(x[:FLAT_SAMPLE], math.isqrt(k))
    cell = ((coarse**2).sum(1)[None] - 2 * x @ coarse.T).argmin(1)
    out = []
    for c in range(len(coarse)):
        mine = x[cell == c]
        if len(mine):
            out.append(balanced_means(mine, max(1, min(len(mine), round(k * len(mine) / len(x))))))
    return np.concatenate(out)


class Index:
    """Centroids and their search: a rough pass by a matrix product in single precision, exact distances among the nearest."""

    def __init__(self, centroids: np.ndarray, peak: float):
        self.c, self.peak, self.probe = centroids, peak, PROBE
        self.mid = centroids.mean(0)
        around = centroids - self.mid
        self.rough, self.square = around.T.astype(np.float32), (around**2).sum(1).astype(np.float32)

    def lift(self, v: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.peak - (v**2).sum(1), 0))
        return np.concatenate([v, extra[:, None]], axis=1)

    def search(self, x: np.ndarray, beam: int = 96) -> tuple[np.ndarray, np.ndarray]:
        """Distances and numbers of the ``beam`` nearest centroids for each row, nearest first."""
        n = len(self.c)
        beam = min(beam, n)
        # a few more than asked for, so that rounding loses none
        some = min(n, beam + 16)
        rough = self.square - 2 * ((x - self.mid).astype(np.float32) @ self.rough)
        near = np.sort(np.argpartition(rough, some - 1, axis=1)[:, :some], axis=1) if some < n else np.tile(np.arange(n), (len(x), 1))
        dist = np.sqrt(((x[:, None, :] - self.c[near]) ** 2).sum(2))
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(dist, order, 1), np.take_along_axis(near, order, 1)

    def lists_of(self, v: np.ndarray) -> list[np.ndarray]:
        """The lists that hold each vector."""
        d, near = self.search(self.lift(v, False), 16)
        out = list(near[:, :1])
        within = (d <= (1 + REPLICATE) * d[:, :1]).sum(1)
        for i in np.flatnonzero(within > 1):
            chosen: list[int] = []
            for dist, j in zip(d[i, : within[i]], near[i]):
                if len(chosen) == MAX_COPIES:
                    break
                if not chosen or np.sqrt(((self.c[chosen] - self.c[j]) ** 2).sum(1)).min() > dist:
                    chosen.append(j)
            out[i] = np.array(chosen)
        return out

    def lists_for(self, q: np.ndarray) -> list[np.ndarray]:
        """The lists that each query reads: ratio pruning, with a least number."""
        d = self.distances(q)
        least = min(MIN_LISTS, d.shape[1])
        reach = np.maximum((1 + self.probe) * d.min(1), np.partition(d, least - 1, axis=1)[:, least - 1])
        return [np.flatnonzero(row) for row in d <= reach[:, None]]

    def scaled(self, q: np.ndarray) -> np.ndarray:
        """Queries lifted at the longest vector's length: order by inner product does not change."""
        return self.lift(q * (np.sqrt(self.peak) / np.sqrt((q**2).sum(1)))[:, None], True)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to all centroids."""
        x = self.scaled(q)
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.c.T + (self.c**2).sum(1)[None], 0))

    def calibrate(self, q: np.ndarray, nearest: list[np.ndarray]) -> None:
        """Widen the probe until the lists of queries ``q`` hold ``RECALL`` of their exact ``nearest`` vectors."""
        d = self.distances(q)
        need = []
        for d_, v in zip(d, nearest):
            need += [d_[lists].min() / max(d_.min(), 1e-12) - 1 for lists in self.lists_of(v)] if len(v) else []
        if need:
            need.sort()
            self.probe = max(PROBE, float(need[math.ceil(RECALL * len(need)) - 1]) + 1e-9)


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Index | None:
    """Fit on at most ``sample`` distinct vectors, chosen by hash; the number of lists follows the number of vectors."""
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("peak")).first()
    if not stats["n"]:
        return None
    # a little more than the sample is picked by hash in the tasks, so each sends its share only
    picked = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, (1.1 * sample + 1000) / stats["n"]) * (1 << 30))
    x = matrix(vectors.where(picked).orderBy(F.xxhash64("key"), "key").limit(sample).select("v").toArrow().column(0))
    k = int(min(MAX_LISTS, max(1, stats["n"] // LIST_ROWS), len(x)))
    lifted = np.concatenate([x, np.sqrt(np.maximum(stats["peak"] - (x**2).sum(1), 0))[:, None]], axis=1)
    index = Index(two_level_means(lifted, k), float(stats["peak"]))
    trials = x[:TRIALS]
    index.calibrate(trials, exact_nearest(vectors, trials))
    return index


def exact_nearest(vectors: DataFrame, q: np.ndarray, top: int = TOP) -> list[np.ndarray]:
    """The ``top`` vectors of largest inner product of each query, itself aside, by one pass over all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty((0, q.shape[1]))) for _ in q]
        worst = np.full(len(q), -np.inf)
        for batch in batches:
            v = matrix(batch.column(0))
            if not len(v):
                continue
            scores = q @ v.T
            # a batch seldom holds one of a query's best so far
            for i in np.flatnonzero(scores.max(1) >= worst):
                s = scores[i]
                s = np.where((v == q[i]).all(1), -np.inf, s) if s.max() >= (q[i] ** 2).sum() * (1 - 1e-9) else s
                at = np.flatnonzero((s >= worst[i]) & np.isfinite(s))
                at = at[np.argsort(-s[at])[:top]]
                s, x = np.concatenate([best[i][0], s[at]]), np.concatenate([best[i][1], v[at]])
                keep = np.argsort(-s)[:top]
                best[i] = s[keep], x[keep]
                worst[i] = s[keep[-1]] if len(keep) == top else -np.inf
        for i, (s, x) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int32)), pa.array(s), pa.array(list(x), pa.list_(pa.float64()))], names=["i", "s", "v"])

    found = vectors.select("v").mapInArrow(work, "i int, s double, v array<double>")
    rows = found.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.desc("s")))).where(F.col("r") <= top).select("i", "v").collect()
    out: list[list] = [[] for _ in q]
    for r in rows:
        out[r["i"]].append(r["v"])
    return [np.array(v).reshape(len(v), q.shape[1]) for v in out]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal width as one array."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def packed(lists: list[np.ndarray], kind: str) -> pa.Array:
    return pa.array([x.astype(kind).tobytes() for x in lists], pa.binary())


def dots(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, each summed in component order."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * v[:, j]
    return out


def groups_of(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(group of each list, blocks of each group): lists in order, GROUP_ROWS vectors a group or a list alone."""
    group, size = np.zeros(len(counts), np.int32), [0]
    for i, n in enumerate(counts):
        if size[-1] and size[-1] + n > GROUP_ROWS:
            size.append(0)
        group[i] = len(size) - 1
        size[-1] += n
    return group, np.maximum(1, -(-np.array(size) // GROUP_ROWS)).astype(np.int32)


def best_of(q: pa.Table, t: pa.Table, top: int) -> Iterator[pa.Table]:
    """The ``top`` + 1 best vectors (one may be the query's own copy) of a block for each of its queries, all that equal the last along."""
    key, v, lists = t.column("key").to_numpy(), matrix(t.column("v")), t.column("list").to_numpy()
    # a vector's copies in several lists of the block are one
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    extra = np.setdiff1d(np.arange(len(key)), first)
    names, column = np.unique(lists, return_inverse=True)
    w = v[first] / np.abs(v).max()
    w = (w / np.sqrt((w**2).sum(1).max())).astype(np.float32).T
    # products in single precision are off by less than half of this, where neither side is longer than 1
    slack = np.float32((v.shape[1] + 8) * 2.0**-23)
    # the least of the largest values of top + 1 parts is not above the value sought
    step = max(1, len(first) // max(128, 4 * (top + 1)))
    parts = len(first) // step
    ids = t.column("ids").combine_chunks()
    for at in range(0, q.num_rows, 256):
        part = q.slice(at, 256)
        x, asked = matrix(part.column("q")), part.column("lists").to_pylist()
        reads = np.zeros((len(x), len(names)), bool)
        for i, b in enumerate(asked):
            reads[i, np.searchsorted(names, np.intersect1d(np.frombuffer(b, np.int32), names))] = True
        seen = reads[:, column[first]]
        if len(extra):
            where, which = np.nonzero(reads[:, column[extra]])
            seen[where, same[extra[which]]] = True
        u = x / np.abs(x).max(1)[:, None]
        s = np.where(seen, (u / np.sqrt((u**2).sum(1))[:, None]).astype(np.float32) @ w, np.float32(-np.inf))
        last = np.full(len(s), -2, np.float32)
        if parts > top + 1:
            most = s[:, : parts * step].reshape(len(s), parts, step).max(2)
            last = np.maximum(last, np.partition(most, -(top + 1), axis=1)[:, -(top + 1)] - slack)
        r, c = np.nonzero(s >= last[:, None])
        c = first[c]
        score = dots(x[r], v[c])
        order, keep = leading(r, score, key[c], top)
        r, c, score = r[order][keep], c[order][keep], score[order][keep]
        yield pa.table([part.column("qkey").take(pa.array(r)), pa.array(key[c]), pa.array(score), ids.take(pa.array(c))], names=["qkey", "key", "score", "ids"])


def leading(group: np.ndarray, score: np.ndarray, key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(an order by group, falling score and key, which of it to keep): the ``top`` + 1 best of each group and all that equal the last."""
    order = np.lexsort((key, -score, group))
    g, s = group[order], score[order]
    if not len(g):
        return order, np.empty(0, bool)
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    sizes = np.diff(np.concatenate([edge, [len(g)]]))
    last = np.where(sizes > top, s[np.minimum(edge + top, len(s) - 1)], -np.inf)
    return order, s >= np.repeat(last, sizes)


def search(rows: DataFrame, top: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row whose vec_id is divisible by ``step``."""
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    valid = staged(valid_vectors(rows), "vectors")
    width = valid.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], result)
    valid = valid.where(F.size("v") == width["w"])
    vectors = staged(distinct_vectors(valid, top), "distinct-vectors")
    index = spark.sparkContext.broadcast(fit(vectors))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = index.value.lists_of(v := matrix(part.column(1)))
                take = pa.array(np.repeat(np.arange(len(v)), [len(x) for x in lists]))
                sub = pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), *[c.take(take) for c in part.columns]], names=["list", "key", "v", "ids"])
                yield sub

    postings = staged(vectors.select("key", "v", "ids").mapInArrow(place, "list int, key long, v array<double>, ids array<long>"), "postings")
    # one count a list: at most MAX_LISTS rows
    counts = {r[0]: r[1] for r in postings.groupBy("list").count().collect()}
    group, blocks = groups_of([counts.get(i, 0) for i in range(max(counts) + 1)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows_, groups, blocks_, lists = [], [], [], []
                for i, mine in enumerate(index.value.lists_for(matrix(part.column(0)))):
                    mine = np.sort(mine[mine < len(group)])
                    for g in np.unique(group[mine]):
                        for b in range(blocks[g]):
                            rows_.append(i)
                            groups.append(g)
                            blocks_.append(b)
                            lists.append(mine[group[mine] == g])
                take = pa.array(rows_, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(blocks_, pa.int32()), part.column(1).take(take), part.column(0).take(take), packed(lists, "int32")], names=["group", "block", "qkey", "q", "lists"])

    asked = valid.where(F.pmod("vec_id", F.lit(step)) == 0).select("v").distinct().select("v", F.xxhash64("v").alias("qkey")).repartition(shuffle_width(spark))
    asked = staged(asked.mapInArrow(ask, "group int, block int, qkey long, q array<double>, lists binary"), "queries")
    # one count a group, of which there are not more than lists
    crowd = {r[0]: r[1] for r in asked.where("block = 0").groupBy("group").count().collect()}
    parts = [max(1, -(-crowd.get(g, 0) // QUERY_ROWS)) for g in range(len(blocks))]
    # a row a list and a row a group: at most MAX_LISTS each; types must be those of the rows, or groups are dealt apart
    of_list = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(group)), "group": group}), "list int, group int")
    of_group = lambda: F.broadcast(spark.createDataFrame(pd.DataFrame({"group": np.arange(len(blocks)), "blocks": blocks, "parts": parts}), "group int, blocks int, parts int"))
    asked = asked.join(of_group(), "group").withColumn("part", F.pmod("qkey", "parts").cast("int"))
    cut = postings.join(F.broadcast(of_list), "list").join(of_group(), "group")
    cut = cut.withColumn("block", F.pmod("key", "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.list_(pa.int64()))], names=["qkey", "key", "score", "ids"])

    def score(q: pa.Table, t: pa.Table) -> pa.Table:
        return pa.concat_tables(best_of(q, t, top)).combine_chunks() if q.num_rows and t.num_rows else none

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of a task's blocks for each query, all that equal the last along, so many lists stay few rows."""

        def best(t: pa.Table) -> pa.Table:
            qkey, key, s = (t.column(c).to_numpy() for c in ("qkey", "key", "score"))
            order = np.lexsort((key, -s, qkey))
            qkey, key, s = qkey[order], key[order], s[order]
            # a vector's copies in several lists are one
            new = np.concatenate([[True], (qkey[1:] != qkey[:-1]) | (key[1:] != key[:-1]) | (s[1:] != s[:-1])])
            order, qkey, s = order[new], qkey[new], s[new]
            edge = np.flatnonzero(np.concatenate([[True], qkey[1:] != qkey[:-1]]))
            sizes = np.diff(np.concatenate([edge, [len(qkey)]]))
            last = np.where(sizes > top, s[np.minimum(edge + top, len(s) - 1)], -np.inf)
            return t.take(pa.array(order[s >= np.repeat(last, sizes)]))

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > 1_000_000:
                held = best(pa.Table.from_batches(held)).to_batches()
                n = sum(b.num_rows for b in held) // 2
        if sum(b.num_rows for b in held):
            yield from best(pa.Table.from_batches(held)).to_batches(max_chunksize=10_000)

    result_rows = "qkey long, key long, score double, ids array<long>"
    found = asked.groupBy("group", "block", "part").cogroup(cut.groupBy("group", "block", "part")).applyInArrow(score, result_rows).mapInArrow(merge, result_rows)
    near = found.dropDuplicates(["qkey", "key"]).select("qkey", "score", F.explode("ids").alias("vec_id"))
    # top + 1 ids a distinct query vector; the query's own row is taken out afterwards
    order = W.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    best = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1).select("qkey", "vec_id", "score")
    queries = valid.where(F.pmod("vec_id", F.lit(step)) == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("qkey")).distinct()
    own = W.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    ranked = queries.join(best, "qkey").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
