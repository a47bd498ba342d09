"""Places and running sums within groups of any size.

A group that holds much of the table is not walked by one task: the rows are cut into ranges of (keys, order), each range of
a group is ranked and summed alone, and the counts and sums of the ranges before are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewing.session import durable


def running(df: DataFrame, keys: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """Adds ``place`` (from 1) and, with ``value``, ``before``: the sum of the group's values that come earlier.

    ``order`` ascends and must be total within a group. Null keys are a group of their own; null values count as 0.
    """
    # the ranges are drawn from a sample: written once, so that every use sees the same
    cut = durable(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    amount = F.coalesce(F.col(value).cast("long"), F.lit(0)) if value else F.lit(0)
    totals = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.sum(amount).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_{k}" for k in [*keys, "_part"]}
    offsets = totals.select(*[F.col(k).alias(v) for k, v in names.items()], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_s")])
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    ranked = cut.withColumn("place", F.row_number().over(within))
    if value:
        ranked = ranked.withColumn("before", F.coalesce(F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.lit(True)
    for k, v in names.items():
        same &= F.col(k).eqNullSafe(F.col(v))
    out = ranked.join(offsets, same).withColumn("place", F.col("place") + F.col("_n_before"))
    if value:
        out = out.withColumn("before", F.col("before") + F.col("_s_before"))
    return out.drop("_part", "_n_before", "_s_before", *names.values())
