"""Queries of the read and search operators, method extraction, differences and matching by likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.functions import text as T
from slatewing.operators import search
from slatewing.operators import snapshot_diff as D
from slatewing.plans.code_rules import _LINES, _PATH, _SETS
from slatewing.plans.snapshots import _SNAPSHOTS
from slatewing.session import spread, table
from slatewing.sources import java


def search_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_code(table(spark, sf_dir, "code_chunk"), query="selectById(", glob="**/service/**", context=1, limit=20)


def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_symbols(table(spark, sf_dir, "code_chunk"), query="archive", cursor=5, limit=20)


def read_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "code_chunk").where("endpoint is not null").select("id")
    return search.read_source(table(spark, sf_dir, "code_chunk"), allowed, 1, 60)


def java_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "code_chunk").where("file_path like '%.java' and chunk_type <> 'METHOD'").select("id", "content")
    return java.method_rows(spread(c)).withColumn("called_symbols", F.array_join("called_symbols", ",")).distinct()


def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "code_chunk").where("change_type in ('MODIFIED', 'RENAMED')").select("id", "base_content", "content")
    d = java.line_diffs(spread(c))
    return d.select("id", "additions", "deletions", F.size("old_ranges").alias("old_ranges"), F.size("new_ranges").alias("new_ranges")).distinct()


def similarity_match(spark: SparkSession, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Findings of one type and file that left and came between consecutive snapshots under other
    fingerprints, paired where each is the other's best and their texts share at least ``least`` of
    their words."""
    findings, tasks = table(spark, sf_dir, "finding"), table(spark, sf_dir, "audit_task")
    order = D.snapshot_order(tasks)
    before = order.where("next_task_id is not null").select("task_id", "next_task_id")
    key = F.lower(D.squeezed(F.col("fingerprint")))
    f = findings.select("task_id", key.alias("fp"), "type", T.normal_path(F.col("file_path")).alias("path"), T.tokens(F.concat_ws(" ", "title", "description")).alias("tokens"), "created_at").where("fp <> ''")
    f = f.groupBy("task_id", "fp").agg(F.max_by(F.struct("type", "path", "tokens"), F.struct("created_at", "tokens")).alias("r")).select("task_id", "fp", "r.*")
    new = f.join(order.where("position > 0").select("task_id"), "task_id")
    old = f.join(before, "task_id").drop("task_id").withColumnRenamed("next_task_id", "task_id")
    came = new.join(old, ["task_id", "fp"], "left_anti").select("task_id", "type", "path", F.col("fp").alias("new_fp"), F.col("tokens").alias("new_tokens"))
    gone = old.join(new, ["task_id", "fp"], "left_anti").select("task_id", "type", "path", F.col("fp").alias("old_fp"), F.col("tokens").alias("old_tokens"))
    score = F.round(T.jaccard(F.col("old_tokens"), F.col("new_tokens")), 6)
    pairs = gone.join(came, ["task_id", "type", "path"]).select("task_id", "old_fp", "new_fp", score.alias("score")).where(F.col("score") >= least)
    best = [F.row_number().over(Window.partitionBy("task_id", a).orderBy(F.desc("score"), b)).alias(n) for a, b, n in (("old_fp", "new_fp", "r"), ("new_fp", "old_fp", "s"))]
    return pairs.select("*", *best).where("r = 1 and s = 1").drop("r", "s")


QUERIES = {f.__name__: f for f in (search_code, search_symbols, read_source, java_methods, line_diff, similarity_match)}

_VALID = _SNAPSHOTS[: _SNAPSHOTS.index(",\nstates as")]
_SIMPLE = "lower(regexp_replace(regexp_replace(symbol_name, '\\(.*', ''), '^.*[#.:]', ''))"
SQL = {
    "search_code": f"""with l as (select distinct id, path, len(r) as last_line, i as line_no from (select id, path, r, unnest(r) as x, generate_subscripts(r, 1) as i from (select id, {_PATH.format('file_path')} as path, {_LINES} as r from code_chunk where content is not null)) where contains(lower(x), 'selectbyid(') and regexp_matches(path, '^(?:.*/)?service/.*$')),
      s as (select path, id, greatest(line_no - 1, 1) as a, least(line_no + 1, last_line) as b from l),
      o as (select *, max(b) over (partition by path, id order by a, b rows between unbounded preceding and 1 preceding) as reach from s),
      k as (select *, sum(case when reach is null or a > reach + 1 then 1 else 0 end) over (partition by path, id order by a, b rows unbounded preceding) as island from o),
      w as (select path, id, min(a)::int as first_line, max(b)::int as end_line, count(*) as hits from k group by path, id, island)
      select * from (select *, row_number() over (order by path, id, first_line) as place from w) where place <= 20""",
    "search_symbols": f"""with r as (select distinct id, symbol_name, {_PATH.format('file_path')} as path, endpoint, start_line from code_chunk where symbol_name is not null),
      s as (select id, symbol_name, path, start_line, (case when {_SIMPLE} = 'archive' then 100 when contains(lower(symbol_name), 'archive') then 50 else 0 end + case when contains(lower(coalesce(endpoint, '')), 'archive') then 20 else 0 end + case when contains(lower(path), 'archive') then 10 else 0 end)::int as score from r)
      select * from (select *, row_number() over (order by score desc, path, start_line, id) as place from s where score > 0) where place between 6 and 25""",
    "read_source": f"select distinct id, (start_line + i - 1)::int as line_no, x as line from (select id, start_line, unnest(r) as x, generate_subscripts(r, 1) as i from (select id, start_line, {_LINES} as r from code_chunk where content is not null and id in (select id from code_chunk where endpoint is not null))) where start_line + i - 1 between 1 and 60",
    "similarity_match": _VALID + f"""
      , f as (select task_id, fp, arg_max({{'type': type, 'path': path, 'tokens': tokens}}, {{'c': created_at, 't': tokens}}) as r from (
        select task_id, lower(trim(regexp_replace(fingerprint, '\\s+', ' ', 'g'))) as fp, type, {_PATH.format('file_path')} as path, {_SETS.format("concat_ws(' ', title, description)")} as tokens, created_at from finding) where fp <> '' group by 1, 2),
      n as (select f.* from f join snap using (task_id) where pos > 0),
      o as (select snap.task_id, f.fp, f.r from f join snap on snap.prev = f.task_id),
      c as (select * from n where not exists (select 1 from o where o.task_id = n.task_id and o.fp = n.fp)),
      g as (select * from o where not exists (select 1 from n where n.task_id = o.task_id and n.fp = o.fp)),
      p as (select g.task_id, g.fp as old_fp, c.fp as new_fp, round(len(list_intersect(g.r.tokens, c.r.tokens)) / len(list_distinct(list_concat(g.r.tokens, c.r.tokens))), 6) as score from g join c on c.task_id = g.task_id and c.r.type = g.r.type and c.r.path = g.r.path),
      k as (select *, row_number() over (partition by task_id, old_fp order by score desc, new_fp) as r, row_number() over (partition by task_id, new_fp order by score desc, old_fp) as s from p where score >= 0.3)
      select task_id, old_fp, new_fp, score from k where r = 1 and s = 1""",
}
