"""Queries of the text operators, by problem number, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewing.llm import credentials, handwritten, leakage, packing, splitting, subjects, truncation
from slatewing.session import spread, table


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "code_chunk").select(*columns))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_lines(_chunks(spark, sf_dir, "id", "file_path", "content"))


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.mask_credentials(_chunks(spark, sf_dir, "id", "file_path", "content"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir, "id", "task_id", "file_path", "content")
    return handwritten.files_not_handwritten(chunks, table(spark, sf_dir, "audit_task"))


_SPLIT = ("id", "task_id", "file_path", "chunk_type", "start_line", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.unit_starts(_chunks(spark, sf_dir, *_SPLIT))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_chunks(_chunks(spark, sf_dir, *_SPLIT))
    return pieces.dropDuplicates(["id", "piece_no"]).drop("unit_line_nos")


def p4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row that is split: what its pieces come to without what they repeat, and pieces above a limit."""
    pieces = p4_pieces(spark, sf_dir)
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + (~F.col("content").endswith("\n")).cast("int")
    over = (F.length("content") > splitting.MAX_CHARS) | (lines > splitting.MAX_LINES)
    # the pieces of one row come together, never more than the row
    added = F.struct("piece_no", F.expr("substring(content, repeated_chars + 1)").alias("text"))
    parts = pieces.groupBy("id").agg(F.array_sort(F.collect_list(added)).alias("parts"), F.sum(over.cast("int")).cast("int").alias("over_limit"))
    text = F.concat_ws("", "parts.text")
    return parts.select("id", F.length(text).alias("characters"), F.md5(text).alias("digest"), "over_limit")


def _cut(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = spread(table(spark, sf_dir, "agent_event").select("event_id", "agent_type", "message"))
    return events, _chunks(spark, sf_dir, "id", "file_path", "chunk_type", "content", "base_content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_values(*_cut(spark, sf_dir))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_shares(*_cut(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every packing must keep: all documents, no container above its capacity, no small document split, no place twice."""
    packed = p6_containers(spark, sf_dir)
    zero = F.lit(0).cast("long")
    full = packed.where("tokens > 0").groupBy("container").agg(F.sum("tokens").alias("n"), F.count("*").alias("items"), F.countDistinct("position").alias("places"))
    each = packed.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("pieces"))
    parts = each.select(F.lit(1).cast("long").alias("documents"), ((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)).cast("long").alias("split_without_need"), zero.alias("over_full"), zero.alias("repeated_places"))
    parts = parts.unionByName(full.select(zero.alias("documents"), zero.alias("split_without_need"), (F.col("n") > packing.CAPACITY).cast("long").alias("over_full"), (F.col("items") - F.col("places")).alias("repeated_places")))
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_spans(spark, sf_dir).select("doc_id", "item_id")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(_documents(spark, sf_dir), table(spark, sf_dir, "eval_item"))


def _subject_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [_documents(spark, sf_dir), *(table(spark, sf_dir, t) for t in ("doc_subject_label", "subject_area", "eval_item"))]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_areas(*_subject_tables(spark, sf_dir)).select("doc_id", "area_code")


def p8_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.corpus_makeup(*_subject_tables(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_masked, p3_found, p4_found, p4_pieces, p4_whole, p5_found, p5_shares, p6_containers, p6_kept,
        p7_found, p7_spans, p8_found, p8_makeup,
    )
}

#: The others cannot be written in SQL at their whole extent; tests compare them with brute force,
#: round trips and held-out labels.
SQL: dict[str, str] = {
    "p6_kept": """
        select count(distinct doc_id) as documents, 0 as split_without_need, 0 as over_full, 0 as repeated_places from documents
        where doc_id is not null""",
    "p4_whole": """
        select distinct id, length(content) as characters, md5(content) as digest, 0 as over_limit from code_chunk
        where id is not null and (length(content) > 12000
          or length(content) - length(replace(content, chr(10), '')) + (right(content, 1) <> chr(10))::int > 160)""",
}
