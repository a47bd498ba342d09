"""Reading and searching code pieces, with checked arguments and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewing.functions import text as T
from slatewing.operators.intervals import context_windows

MOST_QUERY, MOST_ROWS, DEFAULT_ROWS, MOST_LINES = 500, 20, 10, 160


def checked(arguments: dict, allowed: dict[str, type], required: tuple[str, ...] = ()) -> dict:
    """Refuse unknown names, wrong types and missing values; bound limits and cursors."""
    unknown = set(arguments) - set(allowed)
    if unknown:
        raise ValueError(f"unknown arguments: {sorted(unknown)}")
    for name in required:
        if arguments.get(name) in (None, ""):
            raise ValueError(f"{name} is missing")
    for name, value in arguments.items():
        if type(value) is not allowed[name]:
            raise ValueError(f"{name} must be {allowed[name].__name__}")
    if not 1 <= arguments.get("limit", DEFAULT_ROWS) <= MOST_ROWS:
        raise ValueError(f"limit must be 1 to {MOST_ROWS}")
    if arguments.get("cursor", 0) < 0:
        raise ValueError("cursor must not be negative")
    if len(arguments.get("query", "")) > MOST_QUERY:
        raise ValueError(f"query has more than {MOST_QUERY} characters")
    return arguments


def page(df: DataFrame, order: list, cursor: int, limit: int) -> DataFrame:
    """Rows ``cursor + 1`` to ``cursor + limit`` in the order, with their place."""
    top = df.orderBy(*order).limit(cursor + limit)
    place = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("place", place).where(F.col("place") > cursor)


def search_code(chunks: DataFrame, **arguments) -> DataFrame:
    """``(path, id, first_line, end_line, hits, place)``: windows around lines that hold the query literally,
    ignoring case; merged within a piece, ordered by path, piece and line. A null content holds nothing."""
    a = checked(arguments, {"query": str, "glob": str, "context": int, "cursor": int, "limit": int}, ("query",))
    path = T.normal_path(F.col("file_path"))
    rows = chunks.where(F.contains(F.lower("content"), F.lit(a["query"].lower()))).select("id", path.alias("path"), T.lines(F.col("content")).alias("lines"))
    if "glob" in a:
        glob = a["glob"] if "/" in a["glob"] else "**/" + a["glob"]  # without a slash it is a file's name
        rows = rows.where(F.col("path").rlike(T.glob_pattern(glob)))
    hits = rows.distinct().select("id", "path", F.size("lines").alias("last_line"), F.posexplode("lines").alias("pos", "line")).where(F.contains(F.lower("line"), F.lit(a["query"].lower())))
    found = context_windows(hits.withColumn("line_no", F.col("pos") + 1), ["path", "id"], "line_no", a.get("context", 1), "last_line")
    return page(found, ["path", "id", "first_line"], a.get("cursor", 0), a.get("limit", DEFAULT_ROWS))


def search_symbols(chunks: DataFrame, **arguments) -> DataFrame:
    """``(id, symbol_name, path, start_line, score, place)``: whole name 100, part of the name 50, route 20, path 10."""
    a = checked(arguments, {"query": str, "cursor": int, "limit": int}, ("query",))
    q = F.lit(a["query"].lower())
    rows = chunks.where("symbol_name is not null").select("id", "symbol_name", T.normal_path(F.col("file_path")).alias("path"), "endpoint", "start_line").distinct()
    score = (
        F.when(T.simple_name(F.col("symbol_name")) == q, 100).when(F.contains(F.lower("symbol_name"), q), 50).otherwise(0)
        + F.when(F.contains(F.lower(F.coalesce("endpoint", F.lit(""))), q), 20).otherwise(0) + F.when(F.contains(F.lower("path"), q), 10).otherwise(0)
    )
    found = rows.withColumn("score", score).where("score > 0").drop("endpoint")
    return page(found, [F.desc("score"), "path", "start_line", "id"], a.get("cursor", 0), a.get("limit", DEFAULT_ROWS))


def read_source(chunks: DataFrame, allowed: DataFrame, first_line: int, end_line: int) -> DataFrame:
    """Lines of the pieces in ``allowed`` (column id), at most ``MOST_LINES``, as ``(id, line_no, line)``."""
    end = min(end_line, first_line + MOST_LINES - 1)
    rows = chunks.join(allowed.select("id").distinct(), "id", "left_semi").where("content is not null").select("id", "start_line", F.posexplode(T.lines(F.col("content"))).alias("pos", "line"))
    return rows.select("id", (F.col("start_line") + F.col("pos")).alias("line_no"), "line").where((F.col("line_no") >= first_line) & (F.col("line_no") <= end)).distinct()
