"""Queries on changed ranges, code pieces and findings as intervals of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.functions import text as T
from slatewing.operators import intervals as I
from slatewing.operators import rules
from slatewing.plans.code_rules import _LINES, _PATH
from slatewing.session import table

#: Order of severities and confidences, strongest first.
SEVERITIES, CONFIDENCES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"], ["HIGH", "MEDIUM", "LOW"]


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "code_chunk")
    return c.select("id", "task_id", T.normal_path(F.col("file_path")).alias("path"), "symbol_name", "start_line", "end_line").distinct()


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "git_file_change").where("new_path is not null")
    return g.groupBy("task_id", T.normal_path(F.col("new_path")).alias("path")).agg(F.max_by(F.struct("change_type", "additions", "deletions", "new_ranges"), "id").alias("g"))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "git_file_change").where("new_path is not null")
    return g.select("task_id", T.normal_path(F.col("new_path")).alias("path"), F.explode("new_ranges").alias("r")).select(
        "task_id", "path", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end")
    ).distinct()


def _rank(c: str, order: list[str]):
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(F.upper(F.trim(F.col(c))) == v, i).otherwise(out)
    return out


def change_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _pieces(spark, sf_dir).join(_changes(spark, sf_dir), ["task_id", "path"], "left")
    return joined.select("id", F.coalesce("g.change_type", F.lit("NONE")).alias("change_type"), F.col("g.additions").alias("additions"), F.col("g.deletions").alias("deletions"))


def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = I.overlap_join(_pieces(spark, sf_dir), _ranges(spark, sf_dir), ["task_id", "path"], ("start_line", "end_line"), ("range_start", "range_end"))
    return held.groupBy("id").agg(F.count("*").alias("ranges"), F.min("range_start").alias("first_changed"))


def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"range_start": "lo", "range_end": "hi"}
    ranges = _ranges(spark, sf_dir).withColumnsRenamed(names)
    covers = _pieces(spark, sf_dir).where("symbol_name is not null and end_line >= start_line").select("task_id", "path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    return I.subtract(ranges, covers, ["task_id", "path"], "lo", "hi")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "finding")
    return f.select("id", "task_id", "type", T.normal_path(F.col("file_path")).alias("path"), "start_line", "end_line", "severity", "confidence", "title", "endpoint", "created_at").distinct()


def point_in_interval_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding's piece: the narrowest that holds its line, then the smallest id; else the first of the file."""
    points = _findings(spark, sf_dir).select("id", "task_id", "path", F.col("start_line").alias("line")).groupBy("id", "task_id", "path", "line").agg(F.count("*").alias("_n")).drop("_n")
    pieces = _pieces(spark, sf_dir).select("task_id", "path", F.col("id").alias("piece_id"), "start_line", "end_line")
    at = I.point_in_interval(points, pieces, ["task_id", "path"], "line", ("start_line", "end_line"), [(F.col("end_line") - F.col("start_line")).asc(), F.col("piece_id").asc()], ["id", "task_id", "path", "line"])
    first = pieces.groupBy("task_id", "path").agg(F.min("piece_id").alias("first_id"))
    return at.join(first, ["task_id", "path"], "left").select("id", "task_id", "path", "line", F.coalesce("piece_id", "first_id").alias("piece_id"), F.col("piece_id").isNotNull().alias("held"))


def merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one task, type and file that overlap become one: union of lines, strongest ranks, the
    most specific title, all endpoints, the earliest time."""
    f = _findings(spark, sf_dir)
    keys = ["task_id", "type", "path"]
    title = F.trim("title")
    merged = I.islands(f, keys, "start_line", "end_line", order=("id", "created_at")).groupBy(*keys, "island").agg(
        F.count("*").alias("merged"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"),
        F.min(_rank("severity", SEVERITIES)).alias("s"), F.min(_rank("confidence", CONFIDENCES)).alias("c"),
        F.min_by(title, F.struct(-F.length(title), title)).alias("title"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.trim("endpoint") != "", F.trim("endpoint")))), ",").alias("endpoints"),
        F.unix_micros(F.min("created_at")).alias("created_at"),
    )
    pick = [F.element_at(F.array(*[F.lit(v) for v in [*o, "UNKNOWN"]]), F.col(c) + 1).alias(n) for c, n, o in (("s", "severity", SEVERITIES), ("c", "confidence", CONFIDENCES))]
    return merged.select(*keys, "merged", "start_line", "end_line", *pick, "title", "endpoints", "created_at")


def risk_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most severe findings of each task: by rank, then time, then id."""
    f = _findings(spark, sf_dir).groupBy("id", "task_id", "severity", "created_at").agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(_rank("severity", SEVERITIES), "created_at", "id", "severity"))
    return f.withColumn("place", place).where("place <= 20").select("task_id", "place", "id", "severity")


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that name sensitive data, two lines of context, merged within each piece."""
    rows = T.lines(F.col("content"))
    c = table(spark, sf_dir, "code_chunk").where("content is not null")
    lined = c.select("id", F.size(rows).alias("last_line"), F.posexplode(rows).alias("pos", "line")).where(T.contains_any(F.col("line"), rules.SENSITIVE_DATA))
    return I.context_windows(lined.select("id", (F.col("pos") + 1).alias("line_no"), "last_line").distinct(), ["id"], "line_no", 2, "last_line")


def hunk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of a change whose neighbours lie within three lines in both versions form one hunk.

    A side that an edit lacks (insertions, deletions) does not part it; a hunk without new lines has none.
    """
    g = table(spark, sf_dir, "git_file_change")
    # a null list is one without ranges
    sides = [F.coalesce(c, F.filter(other, lambda _: F.lit(False))).alias(c) for c, other in (("old_ranges", "new_ranges"), ("new_ranges", "old_ranges"))]
    edits = g.select("id", *sides).select("id", F.posexplode(F.arrays_zip("old_ranges", "new_ranges")).alias("pos", "e")).distinct()
    by = Window.partitionBy("id").orderBy("pos")
    near = F.lag("pos").over(by).isNotNull()
    for side in ("old_ranges", "new_ranges"):
        near &= F.coalesce(F.col(f"e.{side}.start") - F.lag(f"e.{side}.end").over(by) <= 3, F.lit(True))
    hunks = edits.withColumn("hunk", F.sum(F.when(near, 0).otherwise(1)).over(by))
    return hunks.groupBy("id", "hunk").agg(F.count("*").alias("edits"), F.min("e.new_ranges.start").alias("first_line"), F.max("e.new_ranges.end").alias("end_line"))


def one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that occur in two consecutive tasks of a project under one signature, paired in order."""
    order = Window.partitionBy("project_id").orderBy("created_at", "id")
    t = table(spark, sf_dir, "audit_task").groupBy("id").agg(F.max_by(F.struct("project_id", "created_at"), "version").alias("t")).select("id", "t.*")
    t = t.withColumn("next_id", F.lead("id").over(order))
    named = _pieces(spark, sf_dir).where("symbol_name is not null")
    place = Window.partitionBy("task_id", "symbol_name").orderBy("path", "start_line", "id")
    named = named.withColumn("k", F.row_number().over(place))
    old = named.join(t.where("next_id is not null").select(F.col("id").alias("task_id"), "next_id"), "task_id").select(F.col("next_id").alias("task_id"), "symbol_name", "k", F.col("id").alias("old_id"))
    new = named.select("task_id", "symbol_name", "k", F.col("id").alias("new_id"))
    return old.join(new, ["task_id", "symbol_name", "k"]).select("task_id", "old_id", "new_id")


def impact_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pieces, those impacted (same file as a changed one, not changed), and the rest of the scope."""
    p = table(spark, sf_dir, "code_chunk").select("id", "task_id", T.normal_path(F.col("file_path")).alias("path"), "analysis_scope").distinct()
    changed = p.where("analysis_scope = 'CHANGED'")
    files = changed.select("task_id", "path").distinct()
    impacted = p.join(files, ["task_id", "path"], "left_semi").join(changed.select("id"), "id", "left_anti")
    context = p.join(changed.select("id").unionByName(impacted.select("id")), "id", "left_anti")
    parts = [d.select("task_id", "id", F.lit(n).alias("part")) for n, d in (("CHANGED", changed), ("IMPACTED", impacted), ("CONTEXT", context))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().groupBy("task_id", "part").agg(F.count("*").alias("pieces"))


QUERIES = {
    f.__name__: f
    for f in (
        change_lookup_join, interval_overlap_join, interval_subtract, point_in_interval_ranked, merge_overlaps, risk_order_topk,
        context_windows, hunk_groups, one_to_one_match, impact_set_algebra,
    )
}

_P = f"pieces as (select distinct id, task_id, {_PATH.format('file_path')} as path, symbol_name, start_line, end_line from code_chunk)"
_G = f"g as (select task_id, {_PATH.format('new_path')} as path, max_by({{'t': change_type, 'a': additions, 'd': deletions}}, id) as g from git_file_change where new_path is not null group by 1, 2)"
_R = f"r as (select distinct task_id, path, x.start as lo, x.\"end\" as hi from (select task_id, {_PATH.format('new_path')} as path, unnest(new_ranges) as x from git_file_change where new_path is not null))"
_F = f"f as (select distinct id, task_id, type, {_PATH.format('file_path')} as path, start_line, end_line, severity, confidence, title, endpoint, created_at from finding)"
_S = "case upper(trim(severity)) when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 when 'LOW' then 3 else 4 end"
_C = "case upper(trim(confidence)) when 'HIGH' then 0 when 'MEDIUM' then 1 when 'LOW' then 2 else 3 end"
_HAS = " or ".join(f"contains(lower(x), '{t}')" for t in rules.SENSITIVE_DATA)
SQL = {
    "change_lookup_join": f"with {_P}, {_G} select id, coalesce(g.t, 'NONE') as change_type, g.a as additions, g.d as deletions from pieces left join g using (task_id, path)",
    "interval_overlap_join": f"with {_P}, {_R} select id, count(*) as ranges, min(lo) as first_changed from pieces p join r on p.task_id = r.task_id and p.path = r.path and p.start_line <= r.hi and p.end_line >= r.lo group by id",
    "interval_subtract": f"""with {_P}, {_R}, l as (select distinct task_id, path, unnest(range(lo, hi + 1)) as n from r),
      rest as (select l.* from l where not exists (select 1 from pieces p where p.task_id = l.task_id and p.path = l.path and p.symbol_name is not null and l.n between p.start_line and p.end_line))
      select task_id, path, min(n)::int as lo, max(n)::int as hi from (select *, n - row_number() over (partition by task_id, path order by n) as k from rest) group by task_id, path, k""",
    "point_in_interval_ranked": f"""with {_P}, {_F}, pt as (select distinct id, task_id, path, start_line as line from f),
      h as (select pt.*, p.id as piece_id, row_number() over (partition by pt.id, pt.task_id, pt.path, pt.line order by p.end_line - p.start_line, p.id) as rn
        from pt join pieces p on p.task_id = pt.task_id and p.path = pt.path and pt.line between p.start_line and p.end_line),
      m as (select task_id, path, min(id) as first_id from pieces group by 1, 2)
      select pt.id, pt.task_id, pt.path, pt.line, coalesce(h.piece_id, m.first_id) as piece_id, h.piece_id is not null as held
      from pt left join h on h.rn = 1 and h.id = pt.id and h.task_id = pt.task_id and h.path = pt.path and h.line is not distinct from pt.line left join m on m.task_id = pt.task_id and m.path = pt.path""",
    "merge_overlaps": f"""with {_F}, o as (select *, max(end_line) over (partition by task_id, type, path order by start_line, end_line, id, created_at rows between unbounded preceding and 1 preceding) as reach from f),
      i as (select *, sum(case when reach is null or start_line is null or end_line is null or start_line > reach then 1 else 0 end) over (partition by task_id, type, path order by start_line, end_line, id, created_at rows unbounded preceding) as island from o)
      select task_id, type, path, count(*) as merged, min(start_line) as start_line, max(end_line) as end_line,
        ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'UNKNOWN'][min({_S}) + 1] as severity, ['HIGH', 'MEDIUM', 'LOW', 'UNKNOWN'][min({_C}) + 1] as confidence,
        list_sort(list({{'n': -length(trim(title)), 't': trim(title)}}))[1].t as title,
        coalesce(array_to_string(list_sort(list(distinct trim(endpoint)) filter (where trim(endpoint) <> '')), ','), '') as endpoints, epoch_us(min(created_at)) as created_at
      from i group by task_id, type, path, island""",
    "risk_order_topk": f"with {_F}, d as (select distinct id, task_id, severity, created_at from f) select * from (select task_id, row_number() over (partition by task_id order by {_S}, created_at nulls first, id, severity) as place, id, severity from d) where place <= 20",
    "context_windows": f"""with l as (select distinct id, len(r) as last_line, i as line_no from (select id, r, unnest(r) as x, generate_subscripts(r, 1) as i from (select id, {_LINES} as r from code_chunk where content is not null)) where {_HAS}),
      s as (select id, greatest(line_no - 2, 1) as a, least(line_no + 2, last_line) as b from l),
      o as (select *, max(b) over (partition by id order by a, b rows between unbounded preceding and 1 preceding) as reach from s),
      k as (select *, sum(case when reach is null or a > reach + 1 then 1 else 0 end) over (partition by id order by a, b rows unbounded preceding) as island from o)
      select id, min(a) as first_line, max(b) as end_line, count(*) as hits from k group by id, island""",
    "hunk_groups": """with e as (select distinct id, i as pos, old_ranges[i] as o, new_ranges[i] as n from (select *, unnest(range(1, len(new_ranges) + 1)) as i from git_file_change where len(old_ranges) = len(new_ranges))),
      h as (select *, case when o.start - lag(o."end") over w <= 3 and n.start - lag(n."end") over w <= 3 then 0 else 1 end as fresh from e window w as (partition by id order by pos)),
      k as (select *, sum(fresh) over (partition by id order by pos) as hunk from h)
      select id, hunk::bigint as hunk, count(*) as edits, min(n.start) as first_line, max(n."end") as end_line from k group by id, k.hunk""",
    "one_to_one_match": f"""with {_P}, t as (select id, arg_max(project_id, version) as project_id, arg_max(created_at, version) as created_at from audit_task group by id),
      o as (select id, lead(id) over (partition by project_id order by created_at, id) as next_id from t),
      n as (select *, row_number() over (partition by task_id, symbol_name order by path, start_line, id) as k from pieces where symbol_name is not null)
      select b.task_id, a.id as old_id, b.id as new_id from n a join o on o.id = a.task_id join n b on b.task_id = o.next_id and b.symbol_name = a.symbol_name and b.k = a.k""",
    "impact_set_algebra": f"""with p as (select distinct id, task_id, {_PATH.format('file_path')} as path, analysis_scope from code_chunk),
      c as (select * from p where analysis_scope = 'CHANGED'),
      k as (select p.task_id, p.id, case when p.id in (select id from c) then 'CHANGED' when exists (select 1 from c where c.task_id = p.task_id and c.path = p.path) then 'IMPACTED' else 'CONTEXT' end as part from p)
      select task_id, part, count(distinct id) as pieces from k group by task_id, part""",
}
