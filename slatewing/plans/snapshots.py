"""Queries on what changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewing.operators.snapshot_diff import finding_changes
from slatewing.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("task_id", "fingerprint", "change")


def p2_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each column changes, by task."""
    changed = _changes(spark, sf_dir).where("change = 'CHANGED'")
    return changed.select("task_id", F.explode("changed_columns").alias("column_name")).groupBy("task_id", "column_name").agg(
        F.count("*").alias("changes")
    )


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_changes(table(spark, sf_dir, "finding"), table(spark, sf_dir, "audit_task"))


QUERIES = {"p2_found": p2_found, "p2_columns": p2_columns}

_SNAPSHOTS = r"""
with valid as (
  select id as task_id, project_id, status, created_at from (
    select *, row_number() over (partition by id order by version desc nulls last, created_at desc nulls last) as rn
    from audit_task where id is not null) where rn = 1),
snap as (
  select task_id, project_id, row_number() over (partition by project_id order by created_at, task_id) - 1 as pos,
    lag(task_id) over (partition by project_id order by created_at, task_id) as prev
  from valid where status = 'COMPLETED' and project_id is not null),
states as (
  select * from (
    select task_id, lower(trim(regexp_replace(fingerprint, '\s+', ' ', 'g'))) as fp,
      lower(trim(regexp_replace(coalesce(severity, ''), '\s+', ' ', 'g'))) as severity,
      lower(trim(regexp_replace(coalesce(confidence, ''), '\s+', ' ', 'g'))) as confidence,
      trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) as title,
      coalesce(start_line::varchar, '') as start_line, coalesce(end_line::varchar, '') as end_line,
      trim(regexp_replace(coalesce(endpoint, ''), '\s+', ' ', 'g')) as endpoint,
      trim(regexp_replace(coalesce(description, ''), '\s+', ' ', 'g')) as description,
      trim(regexp_replace(coalesce(remediation, ''), '\s+', ' ', 'g')) as remediation,
      row_number() over (partition by task_id, lower(trim(regexp_replace(fingerprint, '\s+', ' ', 'g'))) order by created_at desc nulls last) as rn
    from finding where task_id is not null) where rn = 1 and fp <> ''),
later as (select s.task_id, s.pos, x.* exclude (task_id) from snap s join states x using (task_id) where s.pos > 0),
earlier as (select s.task_id, x.* exclude (task_id) from snap s join states x on x.task_id = s.prev),
changes as (
  select coalesce(l.task_id, e.task_id) as task_id, coalesce(l.fp, e.fp) as fingerprint,
    case when e.fp is null then 'ADDED' when l.fp is null then 'REMOVED' else 'CHANGED' end as change,
    l.severity <> e.severity as d_severity, l.confidence <> e.confidence as d_confidence, l.title <> e.title as d_title,
    l.start_line <> e.start_line as d_start_line, l.end_line <> e.end_line as d_end_line, l.endpoint <> e.endpoint as d_endpoint,
    l.description <> e.description as d_description, l.remediation <> e.remediation as d_remediation
  from later l full outer join earlier e on l.task_id = e.task_id and l.fp = e.fp),
typed as (
  select * from changes where change <> 'CHANGED' or d_severity or d_confidence or d_title or d_start_line or d_end_line or d_endpoint
    or d_description or d_remediation)
"""
_COLUMNS = ("severity", "confidence", "title", "start_line", "end_line", "endpoint", "description", "remediation")
SQL = {
    "p2_found": _SNAPSHOTS + "select task_id, fingerprint, change from typed",
    "p2_columns": _SNAPSHOTS
    + " union all ".join(
        f"select task_id, '{c}' as column_name, count(*) as changes from typed where change = 'CHANGED' and d_{c} group by task_id" for c in _COLUMNS
    ),
}
