"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: A node with more edges than that is met by a broadcast row, so that no task gathers them; there is one such node for as many edges at most.
CROWD = 100_000


def meet(rows: DataFrame, values: DataFrame, key: str, crowded: bool = True) -> DataFrame:
    """``rows.join(values, key)`` for ``values`` with one row a key and ``n``, the number of rows that may meet it; ``crowded``: some n may pass ``CROWD``."""
    if not crowded:
        return rows.join(values, key)
    crowds = values.where(F.col("n") > CROWD)
    few = rows.join(F.broadcast(crowds.select(key)), key, "left_anti").join(values.where(F.col("n") <= CROWD), key)
    return rows.join(F.broadcast(crowds), key).unionByName(few)


def _shape(now: DataFrame) -> tuple[int, bool]:
    """The most edges of a node, and whether the edges (greater, smaller) are stars around their smallest nodes already."""
    ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    each = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
    most, stars = each.agg(F.max("n"), F.bool_and((F.col("up") == 0) | (F.col("n") == 1))).first()
    return most or 0, stars is not False


def star_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b) of any ordered type; root is the smallest node of its component.

    Each round is a written table, so lineage stays short and a lost executor costs a task. Every round joins edges
    with one minimum for each node: no node's neighbours are gathered in one place, and a node of more than ``CROWD`` edges has its minimum broadcast
    (rounds without such a node broadcast nothing: each broadcast costs the driver a thread and memory). Self-edges and edges with a null
    end are left out; an empty table gives no rows. Rounds grow with the logarithm of a component's size; edges that still
    move after ``most_rounds`` raise RuntimeError.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        most, stars = _shape(now)
        if stars:
            break
        crowded = most > CROWD
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = now.unionByName(up).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        down = meet(up, low, "a", crowded).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # a node stands here with as many others as it has edges, at most
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = meet(down, least, "a", crowded).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components: edges still move after {most_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
