"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut

#: Rows of (a, b) edges per star; a vertex of more neighbours only makes more rows of two columns, never a collected group.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """vertex, component (its smallest vertex) of each vertex with an edge to another one.

    Null ends, self edges and repeated edges have no effect; no edges give no rows.
    Every round is written to the checkpoint folder; the sums tell when nothing changes any more.
    """
    now = cut(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    before = None
    for _ in range(MAX_ROUNDS):
        now = cut(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        before = state
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
