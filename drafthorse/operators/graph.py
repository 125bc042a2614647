"""Connected components of an edge table by rounds of random-priority contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


ROWS_A_TASK = 50_000
#: So many edges are settled by one task: rounds over a few rows cost the driver plans, broadcasts and threads.
LAST_EDGES = 1 << 14


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b), all in one task, to (v, to): each node with the least one of its component."""
    over: dict[int, int] = {}

    def top(x: int) -> int:
        while over.setdefault(x, x) != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            over[max(a, b)] = min(a, b)
    nodes = list(over)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["v", "to"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node in it.

    Each round sends every node to the neighbour (or itself) of least hashed priority and contracts the edges;
    the priorities make the expected number of rounds logarithmic, also for long chains in id order. Once at most
    `last_edges` are left, one task joins them all. Nothing is collected but the number of edges that are left; tasks
    are as many as these ask for.
    """
    e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
    e = materialize(e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left = total = e.count()
    tasks = lambda n: max(4, -(-n // ROWS_A_TASK))
    labels = None
    for turn in range(max_rounds):
        k, last = tasks(left), left <= last_edges
        if last:
            to = e.coalesce(1).mapInArrow(_united, "v long, to long")
        else:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(k)
            rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("p"), c.alias("v"))
            to = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
            to = to.select(F.col("a").alias("v"), F.least("m", rank(F.col("a")))["v"].alias("to")).coalesce(k)
        to = materialize(to)
        labels = to.select(F.col("v").alias("node"), F.col("to").alias("root")) if labels is None else (
            labels.join(to, labels["root"] == to["v"], "left").select("node", F.coalesce("to", "root").alias("root")).coalesce(tasks(total))
        )
        old = e
        if last:
            discard(old)
            break
        one, two = to.select(F.col("v").alias("a"), F.col("to").alias("ra")), to.select(F.col("v").alias("b"), F.col("to").alias("rb"))
        e = e.coalesce(k).join(one.coalesce(k), "a").coalesce(k).join(two.coalesce(k), "b").filter("ra <> rb")
        e = materialize(e.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).coalesce(k).distinct().coalesce(k))
        left = e.count()
        discard(old)
        if not left:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    labels = materialize(labels.coalesce(tasks(total)))
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component").coalesce(tasks(total))
