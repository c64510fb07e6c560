"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolgauge.llm.common import cut

#: Edges of a task. Stars shrink fast, and a round of few edges in many tasks is nothing but small files.
TASK_EDGES = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's smallest node.

    Alternating large-star and small-star rounds: every node's greater
    neighbours, then every node's smaller ones, are linked to its smallest
    neighbour. Each round is two groupings whose minimum is pre-aggregated and
    two joins, whose hot keys adaptive execution splits, so a hub's edges are
    never gathered in one task; edges only shrink towards stars. Ends when a round changes
    nothing, which a count and a hash of the edges tell. What a round writes, to shuffles and
    to the shared folder, is written by as many tasks as its edges fill (``TASK_EDGES``).
    """

    def star(e: DataFrame, large: bool, tasks: int) -> DataFrame:
        """``e`` holds (a, b) with a > b once per edge."""
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        met = both.join(least, F.col("a") == F.col("u"))
        if large:  # neighbours above u meet u's least neighbour (or u itself)
            out = met.where(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # u and its neighbours below meet the least of them
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return cut(out.where(F.col("a") != F.col("b")).coalesce(tasks).distinct().coalesce(tasks))

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        tasks = 1 + seen[0] // TASK_EDGES
        now = star(star(now.coalesce(tasks), True, tasks), False, tasks)
        if (after := mark(now)) == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
