"""Interval operators: overlap joins by blocks, points in intervals, islands, subtraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blocks(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.greatest(F.floor(start / width), F.floor(end / width)))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int = 64) -> DataFrame:
    """Pairs with equal keys whose closed intervals overlap; column names of both sides must differ.

    Each side is spread over blocks of ``width``, so the join is an equi-join on (keys, block) and a key
    with very many intervals is split by position; a pair is kept in the first block that both share.
    Rows with null keys or bounds match nothing.
    """
    x = a.withColumn("_block", F.explode(_blocks(F.col(a_range[0]), F.col(a_range[1]), width)))
    y = b.withColumn("_block", F.explode(_blocks(F.col(b_range[0]), F.col(b_range[1]), width)))
    hit = (F.col(a_range[0]) <= F.col(b_range[1])) & (F.col(a_range[1]) >= F.col(b_range[0]))
    first = F.floor(F.greatest(F.col(a_range[0]), F.col(b_range[0])) / width)
    return x.join(y, [*keys, "_block"]).where(hit & (F.col("_block") == first)).drop("_block")


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``island``: intervals of a key that overlap, touch within ``gap``, or are linked by others
    share a number. Null bounds make an island of their own row."""
    open_ended = F.col(start).isNull() | F.col(end).isNull()
    by = Window.partitionBy(*keys).orderBy(open_ended.desc(), start, end, *order)
    reach = F.max(F.when(~open_ended, F.col(end))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | open_ended | (F.col(start) > reach + gap), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merged(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """The unions ``(keys, start, end)`` of each key's intervals; null bounds are left out."""
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, start, end).distinct()
    return islands(rows, keys, start, end, gap).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def subtract(ranges: DataFrame, covers: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The parts of each key's integer ranges that no cover holds: ``(keys, start, end)``, disjoint."""
    whole = merged(ranges, keys, start, end, gap=1)
    holes = merged(covers, keys, start, end, gap=1)
    # walk ranges' and covers' borders in order: outside of covers and inside of ranges is what is left
    marks = whole.select(*keys, F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("r"), F.lit(0).alias("c")),
        F.struct((F.col(end) + 1).alias("at"), F.lit(-1).alias("r"), F.lit(0).alias("c")),
    )).alias("m")).unionByName(holes.select(*keys, F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(0).alias("r"), F.lit(1).alias("c")),
        F.struct((F.col(end) + 1).alias("at"), F.lit(0).alias("r"), F.lit(-1).alias("c")),
    )).alias("m")))
    steps = marks.groupBy(*keys, F.col("m.at").alias("at")).agg(F.sum("m.r").alias("r"), F.sum("m.c").alias("c"))
    by = Window.partitionBy(*keys).orderBy("at")
    state = steps.select(
        *keys, F.col("at").alias(start), (F.lead("at").over(by) - 1).alias(end),
        F.sum("r").over(by).alias("inside"), F.sum("c").over(by).alias("covered"),
    ).where(f"inside > 0 and covered = 0 and {end} >= {start}")
    return merged(state, keys, start, end, gap=1)


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, interval: tuple[str, str], choose: list[Column], point_id: list[str]) -> DataFrame:
    """Left join of points to the first interval (by ``choose``) of their keys that holds them."""
    held = overlap_join(points, intervals, keys, (point, point), interval)
    best = held.withColumn("_rank", F.row_number().over(Window.partitionBy(*point_id).orderBy(*choose))).where("_rank = 1").drop("_rank")
    extra = [c for c in intervals.columns if c not in keys]
    return points.join(best.select(*point_id, *extra), point_id, "left")


def context_windows(hits: DataFrame, keys: list[str], line: str, around: int, last_line: str) -> DataFrame:
    """Lines around hits, merged where they touch: ``(keys, first_line, end_line, hits)``."""
    spans = hits.select(*keys, F.greatest(F.col(line) - around, F.lit(1)).alias("first_line"), F.least(F.col(line) + around, F.col(last_line)).alias("end_line"))
    return (
        islands(spans, keys, "first_line", "end_line", gap=1)
        .groupBy(*keys, "island")
        .agg(F.min("first_line").alias("first_line"), F.max("end_line").alias("end_line"), F.count("*").alias("hits"))
        .drop("island")
    )
