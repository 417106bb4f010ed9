"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libris.checkpoints import checkpointed

#: Join keys are compared after this is added to their bits.  So a join's sides are
#: dealt anew even after an aggregation on the same column, and a hot node is an
#: ordinary skewed join, which adaptive execution splits.
_SALT = 0x5BF03635


def _key(name: str):
    return F.col(name).bitwiseXOR(F.lit(_SALT).cast("long"))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (hi, lo) of one task, by union-find."""
    hi, lo = [], []
    for b in batches:
        hi.append(b.column("hi").to_numpy())
        lo.append(b.column("lo").to_numpy())
    if not hi:
        return
    nodes, ends = np.unique(np.concatenate([*hi, *lo]), return_inverse=True)
    up = list(range(len(nodes)))
    half = len(ends) // 2
    for x, y in zip(ends[:half].tolist(), ends[half:].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
    for x in range(len(up)):  # a parent is a smaller number, so it is settled already
        up[x] = up[up[x]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100, local: int = 1 << 18) -> DataFrame:
    """(node, root) for every node of ``edges``, root being the smallest node reachable.

    Large-star and small-star rounds: each hangs neighbours on smaller nodes until
    all edges point to a root, in about log2 of the longest path.  Only smallest
    neighbours are aggregated, with partial sums before the shuffle; no node's
    neighbours are gathered.  Each round's edges are checkpointed.  At most ``local`` edges,
    a few megabytes, are settled by one task instead.  Loops, repeated edges and
    edges with a null end don't matter.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).where("hi > lo")
    e = checkpointed(e.distinct())
    before = None
    for _ in range(most_rounds):
        state = tuple(e.agg(F.count("*"), F.bit_xor("hi"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if state[0] <= local:
            return e.repartition(1).mapInArrow(_settle, "node long, root long")
        if state == before:
            root = F.col("lo").alias("root")
            return e.select(F.col("hi").alias("node"), root).unionByName(e.select(F.col("lo").alias("node"), root).distinct())
        before = state
        least = e.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        large = e.join(least.select(_key("u").alias("k"), "m"), _key("lo") == F.col("k"), "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        large = checkpointed(large)
        small = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        again = large.join(small.select(_key("u").alias("k"), "m"), _key("hi") == F.col("k")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = checkpointed(again.unionByName(small.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
