"""Connected components of an undirected graph, by contraction.

Each round hooks every root to its smallest neighbour, flattens the trees by pointer jumping and
contracts the edges, so a round needs grouped minima and joins alone, and edges shrink quickly.
Rounds are cut by tables written to the shared folder. No link or component reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, remove, saved


def _flat(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, root) with a parent below its node for root; nodes without parent are roots.
    Each step follows two parents."""
    now = saved(parents, "parents")
    while True:
        up = lambda s: now.select(F.col("node").alias(f"_{s}"), F.col("root").alias(f"_up_{s}"))  # noqa: B023, E731
        two = now.join(up("a"), F.col("root") == F.col("_a"), "left").select("node", F.coalesce("_up_a", "root").alias("root"))
        step = two.join(up("b"), F.col("root") == F.col("_b"), "left").select("node", F.coalesce("_up_b", "root").alias("root"), F.col("_up_b").isNotNull().alias("moved"))
        step = saved(step, "parents")
        moved = step.where("moved").limit(1).count()
        remove(now.sparkSession, now)
        now = step.select("node", "root")
        if not moved:
            return now


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b of one orderable type) that is not itself
    the smallest of its component; root is that smallest node. Edges may repeat or be loops."""
    left = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots: DataFrame | None = None
    while not left.isEmpty():
        hooked = _flat(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        to = lambda side: hooked.select(F.col("node").alias(f"_{side}"), F.col("root").alias(f"_to_{side}"))  # noqa: B023, E731
        shorter = (
            left.join(to("a"), F.col("a") == F.col("_a"), "left")
            .join(to("b"), F.col("b") == F.col("_b"), "left")
            .select(F.coalesce("_to_a", "a").alias("x"), F.coalesce("_to_b", "b").alias("y"))
            .where("x <> y")
        )
        after = saved(shorter.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if roots is None:
            merged = hooked
        else:
            old = roots.join(to("r"), F.col("root") == F.col("_r"), "left").select("node", F.coalesce("_to_r", "root").alias("root"))
            merged = saved(old.unionByName(hooked), "roots")
            remove(left.sparkSession, roots, hooked)
        remove(left.sparkSession, left)
        left, roots = after, merged
        release(left.sparkSession)
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
