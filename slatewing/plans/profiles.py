"""Queries that profile projects, tasks and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.functions import text as T
from slatewing.plans.code_rules import _PATH
from slatewing.session import table

#: Layers by the folder that names them, first match first; and keyword facts.
LAYERS = ["controller", "service", "mapper", "domain", "config", "generator", "vendor", "build", "util", "test"]
FACTS = {
    "ENTRY": ["@getmapping", "@postmapping", "@putmapping", "@deletemapping"],
    "GUARD": ["@preauthorize", "@secured", "hasrole", "checkpermission"],
    "PERSISTENCE": ["mapper.", "jdbc.query", "<select", "insert into"],
    "TRANSACTION": ["@transactional"],
    "CACHE": ["@cacheable", "cache.evict"],
}
_LAYER_SQL = "case " + " ".join(f"when contains(lower(path), '/{x}/') then '{x.upper()}'" for x in LAYERS) + " else 'OTHER' end"


def _module(path: Column) -> Column:
    return F.when(path.rlike("^[^/]+/src/"), F.substring_index(path, "/", 1)).otherwise(".")


def _layer(path: Column) -> Column:
    out = F.lit("OTHER")
    for x in reversed(LAYERS):
        out = F.when(F.contains(F.lower(path), F.lit(f"/{x}/")), x.upper()).otherwise(out)
    return out


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "code_chunk")
    return c.select("id", "task_id", T.normal_path(F.col("file_path")).alias("path"), "symbol_name", "endpoint", "analysis_scope", "change_type", "chunk_type").distinct()


def module_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pieces(spark, sf_dir)
    return p.groupBy("task_id", _module(F.col("path")).alias("module")).agg(
        F.countDistinct("path").alias("files"), F.count_if(F.col("chunk_type") == "METHOD").alias("methods"), F.count("endpoint").alias("endpoints"),
        F.count_if(F.col("analysis_scope") == "CHANGED").alias("changed"), F.count_if(F.col("analysis_scope") == "IMPACTED").alias("impacted"),
    )


def layer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pieces(spark, sf_dir)
    return p.groupBy(_module(F.col("path")).alias("module"), _layer(F.col("path")).alias("layer")).agg(F.countDistinct("path").alias("files"), F.count("*").alias("pieces"))


def fact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "code_chunk")
    kinds = F.array(*[F.when(T.contains_any(F.concat_ws(" ", "annotations", "content"), words), F.lit(k)) for k, words in FACTS.items()])
    rows = c.select("id", _module(T.normal_path(F.col("file_path"))).alias("module"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")).distinct()
    return rows.groupBy("module", "kind").agg(F.count("*").alias("pieces"))


def tech_evidence_topn(spark: SparkSession, sf_dir: str, most: int = 80) -> DataFrame:
    """The first pieces, by path and id, that show each kind of technology."""
    c = table(spark, sf_dir, "code_chunk")
    kinds = F.array(*[F.when(T.contains_any(F.col("content"), words), F.lit(k)) for k, words in FACTS.items()])
    rows = c.select("id", T.normal_path(F.col("file_path")).alias("path"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")).distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy("path", "id"))
    return rows.withColumn("place", place).where(f"place <= {most}")


def change_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "git_file_change").dropDuplicates(["id"])
    return g.groupBy("task_id", "change_type").agg(
        F.count("*").alias("changes"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count_if("configuration_change").alias("configurations")
    )


def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's valid row with its counts; the children are counted before the joins."""
    t = table(spark, sf_dir, "audit_task").groupBy("id").agg(F.max_by(F.struct("project_id", "status", "progress"), "version").alias("t")).select(F.col("id").alias("task_id"), "t.*")
    counts = {
        "pieces": table(spark, sf_dir, "code_chunk").groupBy("task_id").agg(F.countDistinct("id").alias("pieces")),
        "findings": table(spark, sf_dir, "finding").groupBy("task_id").agg(F.countDistinct("id").alias("findings")),
        "events": table(spark, sf_dir, "agent_event").groupBy("task_id").agg(F.countDistinct("event_id").alias("events"), F.countDistinct("run_id").alias("runs")),
    }
    for df in counts.values():
        t = t.join(df, "task_id", "left")
    return t.select("task_id", "project_id", "status", "progress", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pieces", "findings", "events", "runs")])


def triage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pieces by task: with findings on their file, without, and those of files without a change record."""
    p = _pieces(spark, sf_dir).where("analysis_scope = 'CHANGED'")
    f = table(spark, sf_dir, "finding").select("task_id", T.normal_path(F.col("file_path")).alias("path"), F.lit(1).alias("found")).distinct()
    g = table(spark, sf_dir, "git_file_change").where("new_path is not null").select("task_id", T.normal_path(F.col("new_path")).alias("path"), F.lit(1).alias("recorded")).distinct()
    j = p.join(f, ["task_id", "path"], "left").join(g, ["task_id", "path"], "left")
    return j.groupBy("task_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("found").isNotNull()).alias("investigate"),
        F.count_if(F.col("found").isNull() & F.col("recorded").isNull()).alias("need_context"), F.count_if(F.col("found").isNull() & F.col("recorded").isNotNull()).alias("skip"),
    )


def task_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each task was delivered, and which version is valid."""
    t = table(spark, sf_dir, "audit_task")
    return t.groupBy("id").agg(F.count("*").alias("deliveries"), F.max("version").alias("version"), F.max_by("status", "version").alias("status"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the task with the smallest id: the filter reaches the scan."""
    first = table(spark, sf_dir, "audit_task").agg(F.min("id")).first()[0]
    return table(spark, sf_dir, "code_chunk").where(F.col("task_id") == first).select("id", "file_path", "start_line").distinct()


def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence blocks of findings: the chunk and line that each names."""
    e = table(spark, sf_dir, "finding").where("evidence is not null")
    return e.select(
        "id", "task_id", F.regexp_extract("evidence", r"\[CHUNK (\d+)\]", 1).alias("chunk_id"), F.regexp_extract("evidence", r"\] (\d+) \|", 1).alias("line_no")
    ).where("chunk_id <> ''").distinct()


def confidence_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings ranked by confidence as text (HIGH, LOW, MEDIUM), first ten of each task."""
    f = table(spark, sf_dir, "finding").where("confidence is not null").groupBy("task_id", "id").agg(F.min(F.upper(F.trim("confidence"))).alias("confidence"))
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("confidence", "id"))
    return f.withColumn("place", place).where("place <= 10")


QUERIES = {
    f.__name__: f
    for f in (
        module_profile, layer_profile, fact_index, tech_evidence_topn, change_kind_counts, task_summary, triage_counts, task_versions,
        point_lookup, evidence_text, confidence_lexical,
    )
}


def _facts(expr: str) -> str:
    return " union all ".join(
        f"select id, file_path, '{k}' as kind from code_chunk where " + " or ".join(f"contains(lower(coalesce({expr}, '')), '{w}')" for w in words) for k, words in FACTS.items()
    )


_P = f"p as (select distinct id, task_id, {_PATH.format('file_path')} as path, symbol_name, endpoint, analysis_scope, change_type, chunk_type from code_chunk)"
_M = "case when regexp_matches(path, '^[^/]+/src/') then split_part(path, '/', 1) else '.' end"
SQL = {
    "module_profile": f"with {_P} select task_id, {_M} as module, count(distinct path) as files, count(*) filter (where chunk_type = 'METHOD') as methods, count(endpoint) as endpoints, count(*) filter (where analysis_scope = 'CHANGED') as changed, count(*) filter (where analysis_scope = 'IMPACTED') as impacted from p group by 1, 2",
    "layer_profile": f"with {_P} select {_M} as module, {_LAYER_SQL} as layer, count(distinct path) as files, count(*) as pieces from p group by 1, 2",
    "fact_index": f"with f as (select distinct id, {_PATH.format('file_path')} as path, kind from ({_facts('concat_ws(chr(32), annotations, content)')})) select {_M} as module, kind, count(*) as pieces from f group by 1, 2",
    "tech_evidence_topn": f"with f as (select distinct id, {_PATH.format('file_path')} as path, kind from ({_facts('content')})) select * from (select *, row_number() over (partition by kind order by path, id) as place from f) where place <= 80",
    "change_kind_counts": "with g as (select distinct on (id) * from git_file_change) select task_id, change_type, count(*) as changes, sum(additions)::bigint as additions, sum(deletions)::bigint as deletions, count(*) filter (where configuration_change) as configurations from g group by 1, 2",
    "task_summary": """with t as (select id as task_id, arg_max(project_id, version) as project_id, arg_max(status, version) as status, arg_max(progress, version) as progress from audit_task group by id)
      select t.*, coalesce(c.n, 0) as pieces, coalesce(f.n, 0) as findings, coalesce(e.n, 0) as events, coalesce(e.r, 0) as runs from t
      left join (select task_id, count(distinct id) as n from code_chunk group by 1) c using (task_id) left join (select task_id, count(distinct id) as n from finding group by 1) f using (task_id)
      left join (select task_id, count(distinct event_id) as n, count(distinct run_id) as r from agent_event group by 1) e using (task_id)""",
    "triage_counts": f"""with {_P}, f as (select distinct task_id, {_PATH.format('file_path')} as path from finding), g as (select distinct task_id, {_PATH.format('new_path')} as path from git_file_change where new_path is not null),
      j as (select p.*, f.path is not null as found, g.path is not null as recorded from p left join f using (task_id, path) left join g using (task_id, path) where analysis_scope = 'CHANGED')
      select task_id, count(*) as total, count(*) filter (where found) as investigate, count(*) filter (where not found and not recorded) as need_context, count(*) filter (where not found and recorded) as skip from j group by 1""",
    "task_versions": "select id, count(*) as deliveries, max(version) as version, arg_max(status, version) as status from audit_task group by id",
    "point_lookup": "select distinct id, file_path, start_line from code_chunk where task_id = (select min(id) from audit_task)",
    "evidence_text": r"select * from (select distinct id, task_id, regexp_extract(evidence, '\[CHUNK (\d+)\]', 1) as chunk_id, regexp_extract(evidence, '\] (\d+) \|', 1) as line_no from finding where evidence is not null) where chunk_id <> ''",
    "confidence_lexical": "with f as (select task_id, id, min(upper(trim(confidence))) as confidence from finding where confidence is not null group by 1, 2) select * from (select *, row_number() over (partition by task_id order by confidence, id) as place from f) where place <= 10",
}
