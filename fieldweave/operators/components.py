"""Connected components of an edge table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.shared import settle, small

#: Edges that a task of a round handles: a round over few edges is not dealt to many tasks.
TASK_EDGES = 100_000


def _stars(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One half-step. Each node u links its neighbours to the least node m among them and itself.

    large: only neighbours above u are linked; else those below, and u itself. tasks: most that write.
    """
    both = edges.select("u", "v") if not large else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join below has two sides of its own: broadcast, or with hot nodes split
    least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
    joined = both.join(small(least), "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct().coalesce(tasks)


def _are_stars(edges: DataFrame, tasks: int) -> bool:
    """Whether each node has one edge down, to a node that has none: nothing is left to contract."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.filter((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0)).coalesce(tasks).isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) of every node that ``edges`` (u, v) names.

    Direction, repeated edges and self-loops do not matter; rows with a null end are left out. No
    edges: no rows. Each round's results are written to the shared folder; rounds grow with the
    logarithm of a component's diameter. Few edges, which are counted, take few tasks.
    """
    kind = edges.schema["u"].dataType
    edges = settle(edges.select("u", "v").dropna())
    loops = edges.filter(F.col("u") == F.col("v")).select(F.col("u").alias("node")).distinct()
    tasks = 1 + edges.count() // TASK_EDGES
    now = settle(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(tasks))
    for _ in range(most_rounds):
        if _are_stars(now, tasks):
            break
        now = settle(_stars(settle(_stars(now, True, tasks)), False, tasks))
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").cast(kind).alias("root"))
    roots = roots.union(roots.select("root", "root").distinct())
    return roots.union(loops.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
