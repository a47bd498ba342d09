"""Queries on methods: snapshots and what became of them, where findings lie, joins with mapper files and templates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.functions import text as T
from slatewing.operators import intervals as I
from slatewing.operators import rules
from slatewing.plans.change_intervals import SEVERITIES, _findings
from slatewing.session import durable, table

#: Parts of the score of two methods of one class and name, and the least score that makes them one.
SAME_NAME, SAME_PATH, SAME_BODY, LEAST_SCORE = 50, 20, 30, 70
#: Names of classes that only carry data; states in which a task has ended; lines that are structure only.
CARRIERS = r"(?i)(?:dto|entity|vo|po)\.java$"
ENDED = ["COMPLETED", "FAILED", "CANCELLED"]
STRUCTURE = r"^\s*(?:[{}();,\[\]]*|@\w[\w.]*(?:\(.*\))?|(?:package|import)\s.*|(?:else|try|do|finally)\s*\{?|//.*|/?\*.*)\s*$"


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a method: signature, digests of declaration and body without blanks, guards; repeated deliveries are one."""
    c = table(spark, sf_dir, "code_chunk").where("id is not null and symbol_name like '%#%' and content is not null")
    head = F.regexp_extract("content", r"(?s)^([^{]*)", 1)
    bare = [F.sha2(F.regexp_replace(x, r"[ \t\n\f\r]+", ""), 256) for x in (head, F.substring("content", F.length(head) + 1, F.length("content")))]
    guards = F.filter(F.array(*[F.lit(g) for g in rules.GUARDS]), lambda g: F.contains(F.lower("content"), g))
    return c.select(
        "id", "task_id", T.normal_path(F.col("file_path")).alias("path"), F.regexp_replace("symbol_name", r"\s+", "").alias("signature"),
        F.split_part("symbol_name", F.lit("("), F.lit(1)).alias("named"), bare[0].alias("declaration"), bare[1].alias("body"), F.array_sort(guards).alias("guards"),
    ).distinct()


def method_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _methods(spark, sf_dir).withColumn("guards", F.array_join("guards", ","))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(task_id, next_id)`` of consecutive tasks of a project."""
    t = table(spark, sf_dir, "audit_task").groupBy("id").agg(F.max_by(F.struct("project_id", "created_at"), "version").alias("t")).select("id", "t.*")
    later = F.lead("id").over(Window.partitionBy("project_id").orderBy("created_at", "id"))
    return t.select(F.col("id").alias("task_id"), later.alias("next_id")).where("next_id is not null")


def method_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each method between consecutive tasks of a project: ``(task_id, kind, base_id, target_id)``.

    Methods of one signature are paired one to one, those of the same file first, then in the order of their ids. Of the rest,
    methods of one class and name become SIGNATURE_CHANGED if they reach the least score and each is the other's best.
    Others are DELETED or ADDED, where their file is among the task's changed ones.
    """
    m = durable(_methods(spark, sf_dir))
    base = m.join(_pairs(spark, sf_dir), "task_id").drop("task_id").withColumnRenamed("next_id", "task_id")
    base = durable(base.select("task_id", *[F.col(c).alias(f"b_{c}") for c in ("id", "path", "signature", "named", "declaration", "body", "guards")]))
    target = m.join(base.select("task_id").distinct(), "task_id", "left_semi")
    target = target.select("task_id", *[F.col(c).alias(f"t_{c}") for c in ("id", "path", "signature", "named", "declaration", "body", "guards")])

    def paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """One to one in the order of ids among equal keys."""
        def placed(df: DataFrame, side: str) -> DataFrame:
            return df.withColumn("_k", F.row_number().over(Window.partitionBy("task_id", *(f"{side}_{k}" for k in keys)).orderBy(f"{side}_id")))

        equal = [F.col(f"b_{k}") == F.col(f"t_{k}") for k in keys]
        joined = placed(left, "b").join(placed(right, "t").withColumnsRenamed({"task_id": "_task", "_k": "_l"}), [F.col("task_id") == F.col("_task"), F.col("_k") == F.col("_l"), *equal])
        return joined.drop("_task", "_k", "_l")

    def rest(df: DataFrame, used: DataFrame, side: str) -> DataFrame:
        return df.join(used.select("task_id", f"{side}_id"), ["task_id", f"{side}_id"], "left_anti")

    near = durable(paired(base, target, ["signature", "path"]))
    far = durable(paired(rest(base, near, "b"), rest(target, near, "t"), ["signature"]))
    same = near.unionByName(far)
    left, right = durable(rest(base, same, "b")), durable(rest(target, same, "t"))
    c = F.col
    score = F.lit(SAME_NAME) + F.when(c("b_path") == c("t_path"), SAME_PATH).otherwise(0) + F.when(c("b_body") == c("t_body"), SAME_BODY).otherwise(0)
    scored = left.join(right.withColumnRenamed("task_id", "_task"), (c("task_id") == c("_task")) & (c("b_named") == c("t_named"))).withColumn("score", score).where(c("score") >= LEAST_SCORE)
    best = [F.row_number().over(Window.partitionBy("task_id", f"{a}_id").orderBy(F.desc("score"), f"{z}_id")) for a, z in (("b", "t"), ("t", "b"))]
    renamed = durable(scored.withColumn("_x", best[0]).withColumn("_y", best[1]).where("_x = 1 and _y = 1").select("task_id", "b_id", "t_id"))
    changed = table(spark, sf_dir, "git_file_change").select("task_id", F.explode(F.array("old_path", "new_path")).alias("p")).where("p is not null")
    changed = changed.select("task_id", T.normal_path(c("p")).alias("path")).distinct()
    kinds = F.array_compact(F.array(
        F.when((c("b_declaration") != c("t_declaration")) | (c("b_body") != c("t_body")), "METHOD_MODIFIED"),
        F.when(F.size(F.array_except("t_guards", "b_guards")) > 0, "GUARD_ADDED"), F.when(F.size(F.array_except("b_guards", "t_guards")) > 0, "GUARD_REMOVED"),
    ))
    none = F.lit(None).cast("long")
    out = same.select("task_id", F.explode(kinds).alias("kind"), c("b_id").alias("base_id"), c("t_id").alias("target_id"))
    out = out.unionByName(renamed.select("task_id", F.lit("SIGNATURE_CHANGED").alias("kind"), c("b_id").alias("base_id"), c("t_id").alias("target_id")))
    gone = rest(left, renamed, "b").join(changed.withColumnRenamed("path", "b_path"), ["task_id", "b_path"], "left_semi")
    come = rest(right, renamed, "t").join(changed.withColumnRenamed("path", "t_path"), ["task_id", "t_path"], "left_semi")
    out = out.unionByName(gone.select("task_id", F.lit("METHOD_DELETED").alias("kind"), c("b_id").alias("base_id"), none.alias("target_id")))
    return out.unionByName(come.select("task_id", F.lit("METHOD_ADDED").alias("kind"), none.alias("base_id"), c("t_id").alias("target_id")))


def change_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method changes of each task in the order of a review: by file (target's, else base's), line, kind."""
    at = table(spark, sf_dir, "code_chunk").select("id", T.normal_path(F.col("file_path")).alias("path"), "start_line").groupBy("id").agg(F.min("path").alias("path"), F.min("start_line").alias("line"))
    m = method_changes(spark, sf_dir)
    for side in ("base", "target"):
        m = m.join(at.withColumnsRenamed({"id": f"{side}_id", "path": f"{side}_path", "line": f"{side}_line"}), f"{side}_id", "left")
    order = [F.coalesce("target_path", "base_path"), F.coalesce("target_line", "base_line"), "kind", "base_id", "target_id"]
    return m.select("task_id", F.row_number().over(Window.partitionBy("task_id").orderBy(*order)).alias("place"), "kind", "base_id", "target_id")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "code_chunk").where("id is not null")
    return c.select(F.col("id").alias("piece_id"), "task_id", T.normal_path(F.col("file_path")).alias("path"), "start_line", "end_line", F.trim("endpoint").alias("route")).distinct()


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, task_id, type, path, line, end_line, piece_id, how)`` of findings: the only piece that holds the line, else the only one
    of the finding's endpoint, else the file's only piece, else none. A file that is not known is taken for the only one that ends
    in its path or that its path ends in."""
    pieces = durable(_places(spark, sf_dir))
    f = _findings(spark, sf_dir).select("id", "task_id", "type", "path", F.col("start_line").alias("line"), "end_line", F.trim("endpoint").alias("route")).distinct()
    name = F.regexp_extract("path", "[^/]*$", 0).alias("name")
    files = pieces.select("task_id", F.col("path").alias("known"), name).distinct()
    lost = f.select("task_id", "path", name).distinct().join(files.select("task_id", F.col("known").alias("path")), ["task_id", "path"], "left_anti")
    ends = F.endswith("known", F.concat(F.lit("/"), "path")) | F.endswith("path", F.concat(F.lit("/"), "known"))
    found = lost.where("name <> ''").join(files, ["task_id", "name"]).where(ends).groupBy("task_id", "path").agg(F.count("*").alias("n"), F.min("known").alias("known")).where("n = 1")
    f = f.join(found.select("task_id", "path", "known"), ["task_id", "path"], "left").withColumn("known", F.coalesce("known", "path"))
    f = durable(f.withColumn("_row", F.xxhash64("id", "task_id", "type", "path", "line", "end_line", "route")))
    spots = f.where("line is not null").select("_row", "task_id", F.col("known").alias("path"), F.col("line").alias("lo"), F.col("line").alias("hi"))
    held = I.overlap_join(spots, pieces.select("piece_id", "task_id", "path", "start_line", "end_line").distinct(), ["task_id", "path"], ("lo", "hi"), ("start_line", "end_line"))

    def only(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("_row").agg(F.countDistinct("piece_id").alias("n"), F.min("piece_id").alias(name)).where("n = 1").drop("n")

    named = f.where("route <> ''").select("_row", "task_id", F.col("known").alias("path"), "route").join(pieces.select("piece_id", "task_id", "path", "route").distinct(), ["task_id", "path", "route"])
    single = pieces.groupBy("task_id", "path").agg(F.countDistinct("piece_id").alias("n"), F.min("piece_id").alias("alone")).where("n = 1").select("task_id", F.col("path").alias("known"), "alone")
    f = f.join(only(held, "inside"), "_row", "left").join(only(named, "routed"), "_row", "left").join(single, ["task_id", "known"], "left")
    how = F.when(F.col("inside").isNotNull(), "LINE").when(F.col("routed").isNotNull(), "ENDPOINT").when(F.col("alone").isNotNull(), "ONLY").otherwise("NONE")
    return f.select("id", "task_id", "type", "path", "line", "end_line", F.coalesce("inside", "routed", "alone").alias("piece_id"), how.alias("how"))


def locate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir)


def locate_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces to which any finding of their task points, by a line in their file or by their endpoint."""
    pieces = _places(spark, sf_dir)
    f = _findings(spark, sf_dir).select("task_id", "path", F.col("start_line").alias("lo"), F.col("start_line").alias("hi"), F.trim("endpoint").alias("route")).distinct()
    by_line = I.overlap_join(f.where("lo is not null").select("task_id", "path", "lo", "hi").distinct(), pieces.select("piece_id", "task_id", "path", "start_line", "end_line").distinct(), ["task_id", "path"], ("lo", "hi"), ("start_line", "end_line"))
    by_route = pieces.where("route <> ''").join(f.select("task_id", "route").distinct(), ["task_id", "route"], "left_semi")
    return by_line.select("piece_id").unionByName(by_route.select("piece_id")).distinct()


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one task, type and piece whose lines overlap become one; those without lines stay alone."""
    c = _located(spark, sf_dir).where("piece_id is not null").select("id", "task_id", "type", "piece_id", F.col("line").alias("start_line"), "end_line").distinct()
    merged = I.islands(c, ["task_id", "type", "piece_id"], "start_line", "end_line", order=("id",)).groupBy("task_id", "type", "piece_id", "island")
    return merged.agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("merged"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids")).drop("island")


def _merge_group(part: pd.DataFrame) -> pd.DataFrame:
    """Findings that overlap one another directly or by others, merged until nothing changes: in the order of their lines, each
    with the first that it overlaps and whose symbol is equal or blank; the merged one keeps the symbol."""
    rows = part.sort_values(["start_line", "end_line", "id"])
    merged = [[r.start_line, r.end_line, r.symbol, {r.id}, r.severity_rank] for r in rows.itertuples(index=False)]
    changed = True
    while changed:
        changed, kept = False, []
        for row in merged:
            for other in kept:
                if row[0] <= other[1] and other[0] <= row[1] and (row[2] == other[2] or not row[2] or not other[2]):
                    other[:] = [min(row[0], other[0]), max(row[1], other[1]), other[2] or row[2], other[3] | row[3], min(row[4], other[4])]
                    changed = True
                    break
            else:
                kept.append(row)
        merged = kept
    first = part.iloc[0]
    out = pd.DataFrame([(a, b, c, len(d), ",".join(sorted(d)), e) for a, b, c, d, e in merged], columns=["start_line", "end_line", "symbol", "merged", "ids", "severity_rank"])
    for k in ("task_id", "type", "path"):
        out.insert(0, k, first[k])
    return out


def merge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one task, type and file that overlap become one where their symbols are equal or one is blank.

    A finding's symbol is that of the only piece that holds its line. Only findings that overlap one another, directly or by
    others, come together in a task of the cluster. Findings without lines stay alone.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in SEVERITIES]), F.upper(F.trim("severity"))) - 1, F.lit(-1))
    rank = F.when(rank < 0, len(SEVERITIES)).otherwise(rank).cast("int")
    f = _findings(spark, sf_dir).select("id", "task_id", "type", "path", "start_line", "end_line", rank.alias("severity_rank"))
    f = f.groupBy("id", "task_id", "type", "path", "start_line", "end_line").agg(F.min("severity_rank").alias("severity_rank"))
    c = table(spark, sf_dir, "code_chunk").where("symbol_name is not null").select(F.col("id").alias("piece_id"), "symbol_name").groupBy("piece_id").agg(F.min("symbol_name").alias("symbol"))
    at = _located(spark, sf_dir).where("how = 'LINE'").select("id", "task_id", "type", "path", F.col("line").alias("start_line"), "end_line", "piece_id").distinct()
    named = at.join(c, "piece_id").groupBy("id", "task_id", "type", "path", "start_line", "end_line").agg(F.min("symbol").alias("symbol"))
    keys = ["id", "task_id", "type", "path", "start_line", "end_line"]
    right = named.select(*[F.col(k).alias(f"_{k}") for k in keys], "symbol")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    f = f.join(right, same, "left").select(*keys, "severity_rank", F.coalesce("symbol", F.lit("")).alias("symbol"))
    lined = f.where("start_line is not null and end_line is not null")
    groups = I.islands(lined, ["task_id", "type", "path"], "start_line", "end_line", order=("id", "symbol"))
    schema = "path string, type string, task_id string, start_line int, end_line int, symbol string, merged int, ids string, severity_rank int"
    out = groups.groupBy("task_id", "type", "path", "island").applyInPandas(_merge_group, schema)
    alone = f.where("start_line is null or end_line is null").select("path", "type", "task_id", "start_line", "end_line", "symbol", F.lit(1).alias("merged"), F.col("id").alias("ids"), "severity_rank")
    return out.unionByName(alone)


def mapper_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapper methods and the statements of their class in mapper files of the task: names without a closing number are equal."""
    c = table(spark, sf_dir, "code_chunk")
    plain = lambda x: F.lower(F.regexp_replace(x, r"\d+$", ""))
    files = c.where("content like '%<mapper%'").select("task_id", F.regexp_extract("content", r'<mapper\s+namespace="([^"]*)"', 1).alias("space"), F.explode(F.regexp_extract_all("content", F.lit(r'<(?:select|insert|update|delete)\s+id="([^"]*)"'), F.lit(1))).alias("statement"))
    files = files.select("task_id", plain(F.regexp_extract("space", "[^.]*$", 0)).alias("owner"), plain("statement").alias("name"), "statement").distinct()
    methods = c.where("symbol_name like '%#%'").select("id", "task_id", plain(F.split_part("symbol_name", F.lit("#"), F.lit(1))).alias("owner"), plain(F.split_part(F.split_part("symbol_name", F.lit("#"), F.lit(2)), F.lit("("), F.lit(1))).alias("name")).distinct()
    return methods.join(files, ["task_id", "owner", "name"]).select("id", "task_id", "statement").distinct()


def writer_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that set fields and templates of the task that show fields of the same thing, with the fields they share."""
    c = table(spark, sf_dir, "code_chunk")
    field = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\.set([A-Z]\w*)\("), F.lit(1)))).alias("field")
    thing = F.lower(F.regexp_extract("symbol_name", "^[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]*)?", 0)).alias("thing")
    writers = c.where("symbol_name like '%#%'").select("id", "task_id", thing, field).select("id", "task_id", "thing", F.lower("field").alias("field")).distinct()
    shown = F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\$\{(\w+\.\w+)"), F.lit(1)))).alias("shown")
    t = c.where("chunk_type = 'TEMPLATE'").select(F.col("id").alias("template_id"), "task_id", shown)
    t = t.select("template_id", "task_id", F.lower(F.split_part("shown", F.lit("."), F.lit(1))).alias("thing"), F.lower(F.split_part("shown", F.lit("."), F.lit(2))).alias("field")).distinct()
    met = writers.join(t, ["task_id", "thing", "field"]).groupBy("id", "template_id")
    return met.agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def carrier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of classes that do more than carry data."""
    c = table(spark, sf_dir, "code_chunk").select(T.normal_path(F.col("file_path")).alias("path")).distinct()
    return c.where(F.lower("path").endswith(".java") & ~F.col("path").rlike(CARRIERS))


def csv_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods whose list of called names, kept as text with commas, holds a name: alone, first, last or between."""
    c = table(spark, sf_dir, "code_chunk").where("symbol_name is not null").select("id", F.array_join("called_symbols", ",").alias("called")).distinct()
    arms = F.col("called") == "load"
    for arm in ("load,%", "%,load", "%,load,%"):
        arms |= F.col("called").like(arm)
    return c.where(arms)


def executable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each Java piece that do something, that are structure only, and that are blank."""
    c = table(spark, sf_dir, "code_chunk").where("content is not null and lower(file_path) like '%.java'")
    lined = c.select("id", "task_id", T.lines(F.col("content")).alias("rows")).distinct()
    blank = F.size(F.filter("rows", lambda x: x.rlike(r"^\s*$")))
    structure = F.size(F.filter("rows", lambda x: ~x.rlike(r"^\s*$") & x.rlike(STRUCTURE)))
    return lined.select("id", (F.size("rows") - blank - structure).alias("executable"), structure.alias("structural"), blank.alias("blank")).distinct()


def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long messages as their first 160 and last 80 characters around a mark that says how many are left out."""
    e = table(spark, sf_dir, "agent_event").where("event_id is not null and length(message) > 240").select("event_id", "message").distinct()
    cut = F.concat(F.substring("message", 1, 160), F.lit(" ["), (F.length("message") - 240).cast("string"), F.lit(" left out] "), F.expr("right(message, 80)"))
    return e.select("event_id", cut.alias("shown"))


def cancel_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks as a cancellation of the active ones leaves them: only states that are not final change, with the next version."""
    t = table(spark, sf_dir, "audit_task").groupBy("id").agg(F.max_by("status", "version").alias("status"), F.max("version").alias("version")).where("id is not null")
    ended = F.coalesce(F.col("status").isin(ENDED), F.lit(False))
    return t.select("id", F.when(ended, F.col("status")).otherwise("CANCELLED").alias("status"), (F.col("version") + F.when(ended, 0).otherwise(1)).alias("version"))


def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each task with their size, and whether the task stays within the limits of a snapshot (files, bytes of one file, bytes)."""
    c = table(spark, sf_dir, "code_chunk").where("content is not null").select("id", "task_id", T.normal_path(F.col("file_path")).alias("path"), F.octet_length("content").alias("size")).distinct()
    files = c.groupBy("task_id", "path").agg(F.sum("size").alias("size"))
    per = files.groupBy("task_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    return per.withColumn("within", (F.col("files") <= 100_000) & (F.col("largest") <= 10 * 1024 * 1024) & (F.col("bytes") <= 512 * 1024 * 1024))


QUERIES = {
    f.__name__: f
    for f in (
        method_snapshots, method_changes, change_order, locate_unique, locate_loose, merge_candidates, merge_findings, mapper_methods, writer_templates,
        carrier_filter, csv_member, executable_lines, head_tail, cancel_active, snapshot_scan,
    )
}

_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(trim(coalesce({0}, '')), '\\', '/', 'g'), '/+', '/', 'g'), '^(?:\./)+', '')"
_GUARD_WORDS = "['@preauthorize', '@rolesallowed', '@secured', 'checkpermission', 'checkrole', 'hasauthority', 'hasrole']"
_M = f"""m as materialized (select distinct id, task_id, {_NORMAL.format('file_path')} as path, regexp_replace(symbol_name, '\\s+', '', 'g') as signature, split_part(symbol_name, '(', 1) as named,
    sha256(regexp_replace(head, '\\s+', '', 'g')) as declaration, sha256(regexp_replace(substr(content, length(head) + 1), '\\s+', '', 'g')) as body,
    list_filter({_GUARD_WORDS}, lambda g: contains(lower(content), g)) as guards
  from (select *, regexp_extract(content, '(?s)^([^{{]*)', 1) as head from code_chunk where id is not null and symbol_name like '%#%' and content is not null))"""
_T = "t as (select id, arg_max(project_id, version) as project_id, arg_max(created_at, version) as created_at from audit_task group by id), o as (select * from (select id, lead(id) over (partition by project_id order by created_at, id) as next_id from t) where next_id is not null)"
_CHANGES = f"""with {_M}, {_T}, b as (select o.next_id as task, m.* exclude (task_id) from m join o on o.id = m.task_id), t2 as (select task_id as task, m.* exclude (task_id) from m where task_id in (select task from b)),
  n as materialized (select b.id as b, t.id as t, b.task from (select *, row_number() over (partition by task, signature, path order by id) as k from b) b join (select *, row_number() over (partition by task, signature, path order by id) as k from t2) t using (task, signature, path, k)),
  f as materialized (select b.id as b, t.id as t, b.task from (select *, row_number() over (partition by task, signature order by id) as k from b where (task, id) not in (select task, b from n)) b
    join (select *, row_number() over (partition by task, signature order by id) as k from t2 where (task, id) not in (select task, t from n)) t using (task, signature, k)),
  s as materialized (from n union all from f),
  l as materialized (select * from b where (task, id) not in (select task, b from s)), r as materialized (select * from t2 where (task, id) not in (select task, t from s)),
  c as (select l.task, l.id as b, r.id as t, 50 + (l.path = r.path)::int * 20 + (l.body = r.body)::int * 30 as score from l join r on l.task = r.task and l.named = r.named),
  x as materialized (select task, b, t from (select *, row_number() over (partition by task, b order by score desc, t) as p, row_number() over (partition by task, t order by score desc, b) as q from c where score >= 70) where p = 1 and q = 1),
  g as materialized (select task_id as task, {_NORMAL.format('old_path')} as path from git_file_change where old_path is not null union select task_id, {_NORMAL.format('new_path')} from git_file_change where new_path is not null),
  k as (select s.task as task_id, unnest(list_filter([case when b.declaration <> t.declaration or b.body <> t.body then 'METHOD_MODIFIED' end,
      case when len(list_filter(t.guards, lambda w: not list_contains(b.guards, w))) > 0 then 'GUARD_ADDED' end, case when len(list_filter(b.guards, lambda w: not list_contains(t.guards, w))) > 0 then 'GUARD_REMOVED' end], lambda w: w is not null)) as kind, b.id as base_id, t.id as target_id
    from s join b on b.task = s.task and b.id = s.b join t2 t on t.task = s.task and t.id = s.t
    union all select task, 'SIGNATURE_CHANGED', b, t from x
    union all select task, 'METHOD_DELETED', id, null from l where (task, id) not in (select task, b from x) and (task, path) in (from g)
    union all select task, 'METHOD_ADDED', null, id from r where (task, id) not in (select task, t from x) and (task, path) in (from g))"""
_PLACED = f"p as materialized (select distinct id as piece_id, task_id, {_NORMAL.format('file_path')} as path, start_line, end_line, trim(endpoint) as route from code_chunk where id is not null)"
_FOUND = f"f as materialized (select distinct id, task_id, type, {_NORMAL.format('file_path')} as path, start_line as line, end_line, trim(endpoint) as route from finding)"
_LOCATED = f"""{_PLACED}, {_FOUND}, u as materialized (select a.task_id, a.path, count(*) as n, min(z.path) as known from (select distinct task_id, path from f where (task_id, path) not in (select task_id, path from p)) a
    join (select distinct task_id, path from p) z on z.task_id = a.task_id and regexp_extract(z.path, '[^/]*$') = regexp_extract(a.path, '[^/]*$') and regexp_extract(a.path, '[^/]*$') <> ''
      and (suffix(z.path, '/' || a.path) or suffix(a.path, '/' || z.path)) group by 1, 2),
  q as materialized (select f.*, coalesce(u.known, f.path) as known, row_number() over () as r from f left join u on u.n = 1 and u.task_id = f.task_id and u.path = f.path),
  i as (select r, min(piece_id) as inside from q join p on p.task_id = q.task_id and p.path = q.known and q.line between p.start_line and p.end_line group by r having count(distinct piece_id) = 1),
  e as (select r, min(piece_id) as routed from q join p on p.task_id = q.task_id and p.path = q.known and q.route = p.route and q.route <> '' group by r having count(distinct piece_id) = 1),
  a as (select task_id, path, min(piece_id) as alone from p group by 1, 2 having count(distinct piece_id) = 1),
  z as materialized (select q.id, q.task_id, q.type, q.path, q.line, q.end_line, coalesce(inside, routed, alone) as piece_id, case when inside is not null then 'LINE' when routed is not null then 'ENDPOINT' when alone is not null then 'ONLY' else 'NONE' end as how
    from q left join i using (r) left join e using (r) left join a on a.task_id = q.task_id and a.path = q.known)"""
SQL = {
    "method_snapshots": f"with {_M} select * replace (array_to_string(guards, ',') as guards) from m",
    "method_changes": _CHANGES + " select * from k",
    "change_order": _CHANGES
    + f""", d as (select id, min({_NORMAL.format('file_path')}) as path, min(start_line) as line from code_chunk group by id)
      select task_id, row_number() over (partition by task_id order by coalesce(y.path, w.path), coalesce(y.line, w.line), kind, base_id nulls first, target_id nulls first) as place, kind, base_id, target_id
      from k left join d w on w.id = base_id left join d y on y.id = target_id""",
    "locate_unique": f"with {_LOCATED} select * from z",
    "locate_loose": f"""with {_PLACED}, {_FOUND} select distinct piece_id from p where exists (select 1 from f where f.task_id = p.task_id and f.path = p.path and f.line between p.start_line and p.end_line)
      or (route <> '' and (task_id, route) in (select task_id, route from f where route is not null))""",
    "merge_candidates": f"""with {_LOCATED}, c as (select distinct id, task_id, type, piece_id, line as start_line, end_line from z where piece_id is not null),
      h as (select *, max(end_line) over (partition by task_id, type, piece_id order by start_line, end_line, id rows between unbounded preceding and 1 preceding) as reach from c where start_line is not null and end_line is not null),
      j as (select *, sum(case when reach is null or start_line > reach then 1 else 0 end) over (partition by task_id, type, piece_id order by start_line, end_line, id rows unbounded preceding) as island from h)
      select task_id, type, piece_id, min(start_line) as start_line, max(end_line) as end_line, count(*) as merged, string_agg(distinct id, ',' order by id) as ids from j group by task_id, type, piece_id, island
      union all select task_id, type, piece_id, start_line, end_line, 1, id from c where start_line is null or end_line is null""",
    "mapper_methods": r"""with s as (select task_id, lower(regexp_replace(regexp_extract(regexp_extract(content, '<mapper\s+namespace="([^"]*)"', 1), '[^.]*$'), '\d+$', '')) as owner, unnest(regexp_extract_all(content, '<(?:select|insert|update|delete)\s+id="([^"]*)"', 1)) as statement from code_chunk where content like '%<mapper%')
      select distinct c.id, c.task_id, s.statement from code_chunk c join s on s.task_id = c.task_id and s.owner = lower(regexp_replace(split_part(c.symbol_name, '#', 1), '\d+$', ''))
        and lower(regexp_replace(s.statement, '\d+$', '')) = lower(regexp_replace(split_part(split_part(c.symbol_name, '#', 2), '(', 1), '\d+$', '')) where c.symbol_name like '%#%'""",
    "writer_templates": r"""with w as (select distinct id, task_id, lower(regexp_extract(symbol_name, '^[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]*)?')) as thing, lower(unnest(regexp_extract_all(content, '\.set([A-Z]\w*)\(', 1))) as field from code_chunk where symbol_name like '%#%'),
      t as (select distinct id as template_id, task_id, lower(split_part(x, '.', 1)) as thing, lower(split_part(x, '.', 2)) as field from (select id, task_id, unnest(regexp_extract_all(content, '\$\{(\w+\.\w+)', 1)) as x from code_chunk where chunk_type = 'TEMPLATE'))
      select id, template_id, string_agg(distinct field, ',' order by field) as fields from w join t using (task_id, thing, field) group by 1, 2""",
    "carrier_filter": f"select distinct path from (select {_NORMAL.format('file_path')} as path from code_chunk) where lower(path) like '%.java' and not regexp_matches(lower(path), '(dto|entity|vo|po)\\.java$')",
    "csv_member": "select distinct id, array_to_string(called_symbols, ',') as called from code_chunk where symbol_name is not null and list_contains(called_symbols, 'load')",
    "executable_lines": r"""with r as (select distinct id, task_id, regexp_split_to_array(content, '\r\n|\n|\r') as r from code_chunk where content is not null and lower(file_path) like '%.java'),
      k as (select id, len(r) as n, len(list_filter(r, lambda x: regexp_full_match(x, '\s*'))) as b, len(list_filter(r, lambda x: not regexp_full_match(x, '\s*') and regexp_matches(x,
        '^\s*([{}();,\[\]]*|@\w[\w.]*(\(.*\))?|(package|import)\s.*|(else|try|do|finally)\s*\{?|//.*|/?\*.*)\s*$'))) as s from r)
      select distinct id, n - s - b as executable, s as structural, b as blank from k""",
    "head_tail": "select distinct event_id, left(message, 160) || ' [' || (length(message) - 240)::varchar || ' left out] ' || right(message, 80) as shown from agent_event where event_id is not null and length(message) > 240",
    "cancel_active": """select id, case when s in ('COMPLETED', 'FAILED', 'CANCELLED') then s else 'CANCELLED' end as status, v + case when s in ('COMPLETED', 'FAILED', 'CANCELLED') then 0 else 1 end as version
      from (select id, arg_max(status, version) as s, max(version) as v from audit_task where id is not null group by id)""",
    "snapshot_scan": f"""with c as (select distinct id, task_id, {_NORMAL.format('file_path')} as path, strlen(content) as size from code_chunk where content is not null), s as (select task_id, path, sum(size) as size from c group by 1, 2)
      select task_id, count(*) as files, sum(size)::bigint as bytes, max(size)::bigint as largest, count(*) <= 100000 and max(size) <= 10485760 and sum(size) <= 536870912 as within from s group by 1""",
}
