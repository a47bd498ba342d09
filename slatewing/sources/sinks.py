"""Sinks: partition overwrite, versioned update, cache pruning, reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overwrite_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions that occur in ``df``; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def with_version(current: DataFrame, update: DataFrame, key: str = "id") -> DataFrame:
    """Compare and set: rows of ``update`` replace those whose version they name, with the next version;
    updates that name another version are left out."""
    changed = [c for c in update.columns if c not in (key, "version")]
    u = update.select(key, F.col("version").alias("_expected"), *[F.col(c).alias(f"_{c}") for c in changed])
    j = current.join(u, key, "left")
    fits = F.col("_expected") == F.col("version")
    out = [F.when(fits, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in current.columns if c != "version"]
    return j.select(*out, F.when(fits, F.col("version") + 1).otherwise(F.col("version")).alias("version"))


def kept_snapshots(snapshots: DataFrame, limit: int, least: int = 2) -> DataFrame:
    """The latest snapshots by use that a cache of ``limit`` (at least ``least``) keeps."""
    order = Window.orderBy(F.desc("used_at"), "commit")
    return snapshots.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(limit, least)).drop("_n")


def json_report(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """``(key, report)``: one JSON text a key with a list for each part, ordered."""
    out: DataFrame | None = None
    for name, df in parts.items():
        columns = [c for c in df.columns if c != key]
        grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = grouped if out is None else out.join(grouped, key, "full")
    return out.select(key, F.to_json(F.struct(*parts)).alias("report"))


def html_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One escaped HTML table row a row."""
    cells = [F.concat(F.lit("<td>"), _escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def _escaped(c):
    for char in "&<>\"'":
        c = F.replace(c, F.lit(char), F.lit(html.escape(char)))
    return c
