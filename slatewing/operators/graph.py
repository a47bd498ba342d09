"""Bounded graph operators over edge tables ``(src, dst, ...)``.

Each round joins the frontier with the edges and drops what was seen; rounds are bounded by the depth,
and from the fourth on the frontier is cut through the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewing.session import durable

#: Rounds after which the plan of a frontier is cut.
CUT_EVERY = 4


def _round(df: DataFrame, k: int) -> DataFrame:
    return durable(df) if k % CUT_EVERY == 0 else df


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, once each."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int, through: Column | None = None) -> DataFrame:
    """``(start, node, hops)`` with the fewest hops, up to ``depth``; a start reaches itself in none.

    ``starts``: column ``start``. ``through``: a condition on ``dst`` for nodes that may be entered.
    """
    steps = edges.select("src", "dst") if through is None else edges.where(through).select("src", "dst")
    steps = steps.distinct()
    if depth > CUT_EVERY:  # many rounds read the edges
        steps = durable(steps)
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct()
    frontier = seen
    for k in range(1, depth + 1):
        frontier = (
            frontier.join(steps, frontier["node"] == steps["src"]).select("start", F.col("dst").alias("node"), F.lit(k).alias("hops")).distinct()
            .join(seen.select("start", "node"), ["start", "node"], "left_anti")
        )
        frontier = _round(frontier, k)
        seen = _round(seen.unionByName(frontier), k)
        if k % CUT_EVERY == 0 and frontier.isEmpty():
            break
    return seen


def simple_paths(
    edges: DataFrame, starts: DataFrame, depth: int, carry: dict[str, tuple[Column, Column]] | None = None, keep: Column | None = None,
    states: int | None = None, own: bool = False,
) -> DataFrame:
    """All paths without a repeated node: ``(start, node, hops, path, carried...)``, hops 1..depth, from 0 with ``own``.

    ``carry``: name to (first value by the start's columns, next value by the path's and the edge's columns); ``keep``: a
    condition on the carried values under which a path goes on; ``states``: each start's search ends after so many
    paths, shorter ones first (a bound that belongs to the search, not to the table).
    """
    carry = carry or {}
    front = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"), *[v.alias(n) for n, (v, _) in carry.items()]).distinct()
    found: DataFrame | None = front.withColumn("hops", F.lit(0)) if own else None
    e = edges.withColumnsRenamed({"src": "_src", "dst": "_dst"})
    for k in range(1, depth + 1):
        grown = front.join(e, (F.col("node") == F.col("_src")) & ~F.array_contains("path", F.col("_dst")))
        front = grown.select("start", F.col("_dst").alias("node"), F.concat("path", F.array("_dst")).alias("path"), *[v.alias(n) for n, (_, v) in carry.items()])
        if keep is not None:
            front = front.where(keep)
        if states is not None:
            front = front.withColumn("_place", F.row_number().over(Window.partitionBy("start").orderBy("path"))).where(F.col("_place") <= states).drop("_place")
        front = _round(front, k)
        level = front.withColumn("hops", F.lit(k))
        found = level if found is None else found.unionByName(level)
        if k % CUT_EVERY == 0 and front.isEmpty():
            break
    if states is not None:
        place = F.row_number().over(Window.partitionBy("start").orderBy("hops", "path"))
        found = found.withColumn("_place", place).where(F.col("_place") <= states).drop("_place")
    return found


def fixpoint(edges: DataFrame, facts: DataFrame, rounds: int = 50) -> DataFrame:
    """Facts ``(node, fact)`` spread from ``dst`` to ``src`` until nothing is new (or ``rounds``)."""
    seen = durable(facts.select("node", "fact").distinct())
    fresh, steps = seen, durable(edges.select("src", "dst").distinct())
    for _ in range(rounds):
        fresh = durable(
            fresh.join(steps, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "fact").distinct()
            .join(seen, ["node", "fact"], "left_anti")
        )
        if fresh.isEmpty():
            break
        seen = durable(seen.unionByName(fresh))
    return seen
