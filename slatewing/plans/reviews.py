"""Queries that prepare and check reviews: units, gates, evidence, call sites, effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.functions import text as T
from slatewing.operators import intervals as I
from slatewing.plans.change_intervals import _F, _P, _R, _findings, _pieces, _ranges
from slatewing.plans.code_rules import _PATH, _any, _rule_sql
from slatewing.plans.code_rules import rule_scan_union as _hits
from slatewing.session import table

#: Known types of findings; words that show what a piece does.
TYPES = ["AUTHORIZATION", "SQL_INJECTION", "SENSITIVE_INFORMATION_DISCLOSURE", "STORED_XSS", "VALIDATION_BYPASS"]
EFFECTS = [
    ("SQL", ["jdbc.query", "<select", "<update", "<insert", "<delete", "insert into", "create table"]),
    ("DIRECT_OBJECT_ACCESS", ["selectbyid(", "findbyid(", "getbyid("]),
    ("MUTATION", [".update(", ".insert(", ".delete(", ".save("]),
    ("DATA_ACCESS", ["mapper."]),
]
KINDS = ["ROOT_CAUSE", "RESPONSIBILITY_ANCHOR", "UNCLASSIFIED"]


def token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "code_chunk")
    return c.where(T.any_token(F.concat_ws(" ", "symbol_name", "endpoint"), "archive, a /export {id}")).select("id", "symbol_name", "endpoint").distinct()


def code_without_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "code_chunk").where("content is not null and (file_path like '%.java' or file_path like '%.js')")
    bare = T.without_comments(F.col("content"))
    return c.select("id", F.length(bare).alias("code_characters"), F.sha2(bare, 256).alias("code_digest")).distinct()


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Called names of each method and how often they stand in it as a call; verified where exactly once."""
    c = table(spark, sf_dir, "code_chunk").where("content is not null").select("id", "content", F.explode("called_symbols").alias("called"))
    n = F.regexp_count("content", F.concat(F.lit(r"\b"), F.col("called"), F.lit(r"\w*\s*\(")))
    return c.select("id", "called", n.alias("sites"), (n == 1).alias("verified")).distinct()


def effect_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each piece does, the strongest effect first, counted by type of piece."""
    effect = F.lit("NONE")
    for name, words in reversed(EFFECTS):
        effect = F.when(T.contains_any(F.col("content"), words), name).otherwise(effect)
    rows = table(spark, sf_dir, "code_chunk").select("id", "chunk_type", effect.alias("effect")).distinct()
    return rows.groupBy("chunk_type", "effect").agg(F.count("*").alias("pieces"))


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best evidence of each (task, type, file): by kind of location, then length, then text."""
    kind = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.upper(F.trim("location_kind"))), F.lit(0)).cast("int")
    f = table(spark, sf_dir, "finding").where("evidence is not null").select("task_id", "type", T.normal_path(F.col("file_path")).alias("path"), "evidence", F.when(kind == 0, 9).otherwise(kind).alias("kind"))
    best = F.struct(F.col("kind"), -F.length("evidence"), F.col("evidence"))
    return f.groupBy("task_id", "type", "path").agg(F.min_by("evidence", best).alias("evidence"), F.count("*").alias("blocks"))


def review_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pieces with their rules, changed ranges and findings; each counted before the join."""
    p = table(spark, sf_dir, "code_chunk").where("analysis_scope = 'CHANGED'").select("id").distinct()
    hits = _hits(spark, sf_dir).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    ranges = I.overlap_join(_pieces(spark, sf_dir), _ranges(spark, sf_dir), ["task_id", "path"], ("start_line", "end_line"), ("range_start", "range_end")).groupBy("id").agg(F.countDistinct("range_start", "range_end").alias("ranges"))
    found = _findings(spark, sf_dir).select("task_id", "path", F.col("id").alias("finding_id"), F.col("start_line").alias("line")).distinct()
    held = I.overlap_join(_pieces(spark, sf_dir), found.withColumn("line_end", F.col("line")), ["task_id", "path"], ("start_line", "end_line"), ("line", "line_end")).groupBy("id").agg(F.countDistinct("finding_id").alias("findings"))
    for df in (hits, ranges, held):
        p = p.join(df, "id", "left")
    return p.select("id", F.coalesce("rules", F.lit("")).alias("rules"), F.coalesce("ranges", F.lit(0)).alias("ranges"), F.coalesce("findings", F.lit(0)).alias("findings"))


def finding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each finding would be refused: the first check that fails, or ACCEPTED."""
    files = _pieces(spark, sf_dir).groupBy("task_id", "path").agg(F.max("end_line").alias("last_line"))
    f = _findings(spark, sf_dir).select("id", "task_id", "type", "path", "start_line", "end_line").distinct().join(files, ["task_id", "path"], "left")
    reason = (
        F.when(~F.coalesce(F.col("type").isin(TYPES), F.lit(False)), "UNKNOWN_TYPE")
        .when(F.col("path") == "", "NO_FILE")
        .when(F.col("start_line").isNull() | F.col("end_line").isNull() | (F.col("end_line") < F.col("start_line")), "NO_LINES")
        .when(F.col("last_line").isNull(), "FILE_NOT_IN_SCOPE")
        .when(F.col("start_line") > F.col("last_line"), "LINE_BEYOND_FILE")
        .otherwise("ACCEPTED")
    )
    return f.groupBy("task_id", reason.alias("reason")).agg(F.count("*").alias("findings"))


def change_context(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """Up to three changed ranges of each piece's file: those that touch the piece first, then by line.

    Those that touch are met by blocks of lines. Of the others only the file's first ``most`` can come in, since those of
    them that touch take a place themselves; so no piece meets all ranges of its file.
    """
    p = _pieces(spark, sf_dir).select("id", "task_id", "path", "start_line", "end_line").distinct()
    ranges = _ranges(spark, sf_dir)
    touching = I.overlap_join(p, ranges, ["task_id", "path"], ("start_line", "end_line"), ("range_start", "range_end"))
    first = F.row_number().over(Window.partitionBy("task_id", "path").orderBy("range_start", "range_end"))
    firsts = p.join(ranges.withColumn("_k", first).where(F.col("_k") <= most).drop("_k"), ["task_id", "path"])
    columns = ("id", "start_line", "end_line", "range_start", "range_end")
    j = touching.select(*columns).unionByName(firsts.select(*columns)).distinct()
    touches = F.coalesce((F.col("start_line") <= F.col("range_end")) & (F.col("end_line") >= F.col("range_start")), F.lit(False))
    place = F.row_number().over(Window.partitionBy("id").orderBy(touches.desc(), "range_start", "range_end"))
    return j.select("id", "range_start", "range_end", touches.alias("touches"), place.alias("place")).where(f"place <= {most}")


def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose message holds a JSON object, by kind, and how many of those name a tool."""
    e = table(spark, sf_dir, "agent_event").select("event_id", "event_type", T.json_body(F.col("message")).alias("body")).distinct()
    return e.groupBy("event_type").agg(F.count("body").alias("objects"), F.count_if(F.contains("body", F.lit('"tool"'))).alias("with_tool"))


def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, active tasks, findings and changed lines by project; children are summed by task first."""
    t = table(spark, sf_dir, "audit_task").groupBy("id").agg(F.max_by(F.struct("project_id", "status"), "version").alias("t")).select(F.col("id").alias("task_id"), "t.*")
    g = table(spark, sf_dir, "git_file_change").dropDuplicates(["id"]).groupBy("task_id").agg(F.sum("additions").alias("a"), F.sum("deletions").alias("d"))
    f = table(spark, sf_dir, "finding").groupBy("task_id").agg(F.countDistinct("id").alias("f"))
    j = t.join(g, "task_id", "left").join(f, "task_id", "left")
    total = {n: F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("additions", "a"), ("deletions", "d"), ("findings", "f"))}
    return j.groupBy("project_id").agg(F.count("*").alias("tasks"), F.count_if(~F.col("status").isin("COMPLETED", "FAILED", "CANCELLED")).alias("active"), *total.values())


QUERIES = {
    f.__name__: f
    for f in (
        token_match, code_without_comments, call_sites, effect_kinds, evidence_merge, review_units, finding_gate, change_context,
        json_payload, project_rollup,
    )
}

_BARE = "regexp_replace(content, '" + T.LITERAL_OR_COMMENT.replace("'", "''") + "', '\\1', 'g')"
_EFFECT = "case " + " ".join(f"when {_any('content', words)} then '{name}'" for name, words in EFFECTS) + " else 'NONE' end"
SQL = {
    "token_match": f"select distinct id, symbol_name, endpoint from code_chunk where {_any('concat_ws(chr(32), symbol_name, endpoint)', ['archive', '/export', '{id}'])}",
    "code_without_comments": f"select distinct id, length(b) as code_characters, sha256(b) as code_digest from (select id, {_BARE} as b from code_chunk where content is not null and (file_path like '%.java' or file_path like '%.js'))",
    "call_sites": r"select distinct id, called, n as sites, n = 1 as verified from (select id, called, len(regexp_extract_all(content, '\b' || called || '\w*\s*\(')) as n from (select id, content, unnest(called_symbols) as called from code_chunk where content is not null))",
    "effect_kinds": f"select chunk_type, effect, count(*) as pieces from (select distinct id, chunk_type, {_EFFECT} as effect from code_chunk) group by 1, 2",
    "evidence_merge": f"""with f as (select task_id, type, {_PATH.format('file_path')} as path, evidence, coalesce(nullif(coalesce(list_position({KINDS}, upper(trim(location_kind))), 0), 0), 9) as kind from finding where evidence is not null)
      select task_id, type, path, list_sort(list({{'k': kind, 'n': -length(evidence), 'e': evidence}}))[1].e as evidence, count(*) as blocks from f group by 1, 2, 3""",
    "review_units": f"""with {_P}, {_R}, {_F}, h as (select id, string_agg(distinct rule, ',' order by rule) as rules from ({_rule_sql()}) group by id),
      r2 as (select id, count(distinct (lo, hi)) as ranges from pieces p join r on p.task_id = r.task_id and p.path = r.path and p.start_line <= r.hi and p.end_line >= r.lo group by id),
      f2 as (select p.id, count(distinct f.id) as findings from pieces p join f on p.task_id = f.task_id and p.path = f.path and f.start_line between p.start_line and p.end_line group by p.id)
      select id, coalesce(rules, '') as rules, coalesce(ranges, 0) as ranges, coalesce(findings, 0) as findings from (select distinct id from code_chunk where analysis_scope = 'CHANGED') left join h using (id) left join r2 using (id) left join f2 using (id)""",
    "finding_gate": f"""with {_P}, {_F}, m as (select task_id, path, max(end_line) as last_line from pieces group by 1, 2), d as (select distinct id, task_id, type, path, start_line, end_line from f)
      select d.task_id, case when not coalesce(type in ({', '.join(repr(t) for t in TYPES)}), false) then 'UNKNOWN_TYPE' when d.path = '' then 'NO_FILE' when start_line is null or end_line is null or end_line < start_line then 'NO_LINES'
        when last_line is null then 'FILE_NOT_IN_SCOPE' when start_line > last_line then 'LINE_BEYOND_FILE' else 'ACCEPTED' end as reason, count(*) as findings from d left join m on m.task_id = d.task_id and m.path = d.path group by 1, 2""",
    "change_context": f"""with {_P}, {_R}, j as (select p.id, r.lo as range_start, r.hi as range_end, start_line <= hi and end_line >= lo as touches from (select distinct id, task_id, path, start_line, end_line from pieces) p join r on p.task_id = r.task_id and p.path = r.path)
      select * from (select *, row_number() over (partition by id order by touches desc, range_start, range_end) as place from j) where place <= 3""",
    "json_payload": r"""with e as (select distinct event_id, event_type, nullif(regexp_extract(regexp_replace(coalesce(message, ''), '```(?:json)?', '', 'g'), '(?s)\{.*\}'), '') as body from agent_event)
      select event_type, count(body) as objects, count(*) filter (where contains(body, '"tool"')) as with_tool from e group by 1""",
    "project_rollup": """with t as (select id as task_id, arg_max(project_id, version) as project_id, arg_max(status, version) as status from audit_task group by id),
      g as (select task_id, sum(additions) as a, sum(deletions) as d from (select distinct on (id) * from git_file_change) group by 1), f as (select task_id, count(distinct id) as f from finding group by 1)
      select project_id, count(*) as tasks, count(*) filter (where status not in ('COMPLETED', 'FAILED', 'CANCELLED')) as active, coalesce(sum(a), 0)::bigint as additions, coalesce(sum(d), 0)::bigint as deletions, coalesce(sum(f), 0)::bigint as findings from t left join g using (task_id) left join f using (task_id) group by 1""",
}
