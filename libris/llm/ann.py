"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is cut into balanced parts, and a small
network learns to tell a vector's part.  Every row is filed under its most
probable part; a query visits the several parts that are most probable for it,
and what lies there is ranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from libris.llm.common import checkpointed, smallest


@dataclass(frozen=True)
class Router:
    """A network of one hidden layer that gives log-probabilities of parts for unit vectors."""

    mean: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = unit(x.astype(np.float64)).astype(np.float32) - self.mean
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row of unit vectors, by blocks."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Cuts a neighbour graph into ``parts`` parts of nearly equal size with few edges between them.

    Starts from centres with room for (1 + slack) of the mean, filled in order of
    closeness; then nodes move to the part where most of their neighbours are, as
    long as that part has room, which lessens the cut in every round.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(n, parts, replace=False)]
    room = int(np.ceil(n / parts * (1 + slack)))
    part = np.zeros(n, np.int64)
    for _ in range(6):
        s = x @ centres.T
        order = np.argsort(-s.max(axis=1), kind="stable")
        prefer = np.argsort(-s, axis=1, kind="stable")
        size = np.zeros(parts, np.int64)
        for i in order.tolist():
            for p in prefer[i].tolist():
                if size[p] < room:
                    part[i], size[p] = p, size[p] + 1
                    break
        centres = unit(np.stack([x[part == p].mean(axis=0) if (part == p).any() else x[rng.integers(n)] for p in range(parts)]) + 1e-12)
    both = [*graph.ravel(), *np.repeat(np.arange(n), graph.shape[1])]
    ends = np.array([*np.repeat(np.arange(n), graph.shape[1]), *graph.ravel()])
    both = np.array(both)
    order = np.argsort(both, kind="stable")
    both, ends = both[order], ends[order]
    starts = np.searchsorted(both, np.arange(n + 1)).tolist()
    size = np.bincount(part, minlength=parts)
    least = int(n / parts * (1 - 2 * slack))
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n).tolist():
            around = np.bincount(part[ends[starts[i] : starts[i + 1]]], minlength=parts)
            own = part[i]
            if size[own] <= least:
                continue
            gain = np.where(size < room, around, -1)
            to = int(gain.argmax())
            if gain[to] > around[own]:
                part[i] = to
                size[own] -= 1
                size[to] += 1
                moved += 1
        if moved < n // 200:
            break
    return part


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, batch: int = 256, rate: float = 3e-3, seed: int = 5) -> Router:
    """Fits the network to ``target`` (n, parts), each row a distribution over parts, by Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    k = target.shape[1]
    mean = x.mean(axis=0).astype(np.float32)
    z, target = (x - mean).astype(np.float32), target.astype(np.float32)
    weights = [rng.normal(0, np.sqrt(2 / d), (d, hidden)).astype(np.float32) * 2, np.zeros(hidden, np.float32), rng.normal(0, np.sqrt(1 / hidden), (hidden, k)).astype(np.float32), np.zeros(k, np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(n), max(1, n // batch)):
            step += 1
            a = z[at]
            h = np.maximum(a @ weights[0] + weights[1], 0)
            s = h @ weights[2] + weights[3]
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[at]) / len(at)
            gh = (g @ weights[2].T) * (h > 0)
            lr = rate * (1 - epoch / epochs) + 1e-4
            for w, grad, m, v in zip(weights, (a.T @ gh, gh.sum(0), h.T @ g, g.sum(0)), first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(mean, *weights)


def fit(sample: np.ndarray, parts: int, target: float = 0.95, k: int = 5, neighbours: int = 10) -> tuple[Router, int]:
    """A router for ``parts`` parts (fewer if the sample is small), and how many parts a query must visit.

    A tenth of the sample is kept from the graph and the network.  Visits are as many
    as bring these vectors ``target`` of their k nearest in the sample.  A vector's
    target spreads over the parts of its neighbours and its own.
    """
    x = unit(sample.astype(np.float64)) if len(sample) else np.zeros((0, 1))
    held = len(x) // 10
    parts = max(1, min(parts, (len(x) - held) // 16))
    d = x.shape[1]
    if parts == 1:
        return Router(np.zeros(d, np.float32), np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)), 1
    learn = x[held:]
    near = min(neighbours, len(learn) - 1)
    graph = neighbour_graph(learn, near)
    part = balanced_parts(learn, graph, parts)
    goal = np.zeros((len(learn), parts))
    np.add.at(goal, (np.repeat(np.arange(len(learn)), near), part[graph].ravel()), 0.5 / near)
    goal[np.arange(len(learn)), part] += 0.5
    router = train_router(learn, goal)
    home = router.scores(x).argmax(axis=1)
    s = x[:held] @ x.T
    s[np.arange(held), np.arange(held)] = -np.inf
    true = home[np.argpartition(-s, k - 1, axis=1)[:, :k]]
    order = np.argsort(-router.scores(x[:held]), axis=1, kind="stable")
    at = np.empty_like(order)
    np.put_along_axis(at, order, np.arange(parts)[None, :].repeat(held, 0), axis=1)
    found = np.bincount(np.take_along_axis(at, true, axis=1).ravel(), minlength=parts).cumsum() / true.size
    return router, int(np.searchsorted(found, target) + 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """(n, d) from a list column whose rows have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def valid(vector: str) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not zero."""
    c = F.col(vector)
    finite = ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda v: v != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    sample: int = 8192,
    parts: int | None = None,
    target: float = 0.95,
    block: int = 20_000,
) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of each row for which ``is_query`` holds, itself excepted.

    Score is the cosine in double precision, ranked largest first, ties to the
    smaller id.  The router is fitted on the ``sample`` distinct vectors of the
    smallest hashes, a bound on what the driver holds; every row is indexed.  Unless given, there are
    as many parts as hold 4,096 entries each, 64 at least and one for 16 sample rows at most.  Equal
    vectors are one entry with their k + 1 smallest ids, all that a result can hold
    (each task passes on no more of them), so a vector with a third of all rows is
    one row from there on.  A query visits as many of its most probable parts as
    brought ``target`` recall on the sample, and further ones in that order as long as
    the parts visited hold fewer than k + 1 rows.  A part of over ``block`` entries, or visited by more queries,
    is cut into blocks of either side, each pair of which is searched by a task of its own.  Rows whose
    vector is not :func:`valid`, has another length than most, or whose id is null
    take no part.
    """
    given = vectors.where(F.col(id_col).isNotNull() & valid(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    lengths = given.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    spark = vectors.sparkSession
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    given = given.where(F.size("v") == lengths["d"])
    ranked = given.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = checkpointed(ranked.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("key", F.xxhash64("v")))
    n = entries.count()
    chosen = smallest(entries.select("key", "v"), "key", sample, n).select("v").toPandas()
    router, probes = fit(np.array(chosen["v"].tolist(), np.float64).reshape(len(chosen), lengths["d"]), parts or max(64, min(sample // 16, n // 4096)), target, k)
    n_parts = router.parts

    @F.arrow_udf("int")
    def home(v: pa.Array) -> pa.Array:
        return pa.array(router.scores(_matrix(v)).argmax(axis=1).astype(np.int32)) if len(v) else pa.array([], pa.int32())

    filed = checkpointed(entries.withColumn("part", home("v")))
    # at most n_parts rows
    sizes = {r["part"]: (r["n"], r["m"]) for r in filed.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("m")).collect()}
    grid = np.array([max(1, -(-sizes.get(p, (0, 0))[0] // block)) for p in range(n_parts)])
    rows_in = np.array([sizes.get(p, (0, 0))[1] for p in range(n_parts)], np.int64)

    @F.arrow_udf("array<int>")
    def visits(v: pa.Array) -> pa.Array:
        order = np.argsort(-router.scores(_matrix(v)), axis=1, kind="stable")
        held = np.cumsum(rows_in[order], axis=1)
        n = np.maximum(probes, (held < k + 1).sum(axis=1) + 1)
        return pa.array([[p for p in row[:m].tolist() if rows_in[p]] for row, m in zip(order, np.minimum(n, n_parts).tolist(), strict=True)], pa.list_(pa.int32()))

    queries = given.where("q").select("id", "v").dropDuplicates(["id", "v"])
    visiting = checkpointed(queries.withColumn("part", F.explode(visits("v"))))
    visitors = {r["part"]: r["count"] for r in visiting.groupBy("part").count().collect()}
    slices = [max(1, -(-visitors.get(p, 0) // block)) for p in range(n_parts)]

    def of_part(values: Sequence[int]) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("part") + 1)

    block_of, slice_of = F.pmod(F.xxhash64("key", F.lit(7)), of_part(grid)), F.pmod(F.xxhash64("id", "v"), of_part(slices))
    cell = ("part", "block", "slice")
    every = lambda values: F.sequence(F.lit(0), of_part(values) - 1)
    candidates = filed.withColumn("slice", F.explode(every(slices))).select("part", block_of.cast("int").alias("block"), "slice", "v", "ids")
    asked = visiting.withColumn("block", F.explode(every(grid))).select("part", "block", slice_of.cast("int").alias("slice"), F.col("id").alias("query"), "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x = np.array(left["v"].tolist(), np.float64)
        norms = unit(x)
        ids = left["ids"].tolist()
        found = []
        for a in range(0, len(right), 512):
            part = right.iloc[a : a + 512]
            y = unit(np.array(part["v"].tolist(), np.float64))
            s = y @ norms.T
            m = min(len(ids), k + 1)
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            # ties at the edge all stay: the smaller id decides
            edge = np.take_along_axis(s, top, axis=1).min(axis=1)
            q, c = np.nonzero(s >= edge[:, None] - 1e-12)
            # the score of a pair is summed in one order wherever it is met
            exact = (y[q] * norms[c]).sum(axis=1)
            for who, entry, score in zip(part["query"].to_numpy()[q].tolist(), c.tolist(), exact.tolist(), strict=True):
                found += [(who, i, score) for i in ids[entry] if i != who]
        return pd.DataFrame(found, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    hits = candidates.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(search, "query_id long, id long, score double")
    hits = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))  # an id may have several vectors
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
