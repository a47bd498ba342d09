"""Queries on the call graph of the code pieces, and on the history of commits.

Nodes are the methods of a task. A call leads to the methods of the same task whose name begins with the called name and
whose class is about the same thing as the caller's (the first two words of its name): an equality of keys, so that a
task of any size is joined without pairs of all its methods. An edge is HIGH if it is the call's only target, MEDIUM if
one of several in the caller's own class, else LOW. Searches leave LOW edges out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.functions import text as T
from slatewing.operators import graph as G
from slatewing.operators import rules
from slatewing.plans.code_rules import _BYPASS_RE2, _PATH, _any, _matches
from slatewing.session import durable, table

#: Bounds of the search as the reference sets them: calls of a path, states of an entry, flows of an entry; paths each
#: way of an exploration.
CALLS, STATES, FLOWS, QUOTA = 10, 1000, 20, 4
ROLE_GUARDS, OWNERS = rules.GUARDS, [*rules.OWNERSHIP, "getcurrentuser", "checktenant"]
MUTATES, GATEWAYS = [".update(", ".insert(", ".delete(", ".save("], ["paymentgateway.", "refundgateway.", "bankclient.", "adminclient."]
STORES, SAFE_SQL = ["mapper.", "repository.", "jdbctemplate", "entitymanager"], ["preparestatement", "namedparameterjdbctemplate"]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods, with what the searches ask of them; a method delivered twice is one."""
    c = table(spark, sf_dir, "code_chunk").where("id is not null and symbol_name like '%#%'")
    method = F.split_part("symbol_name", F.lit("#"), F.lit(2))
    bare = F.regexp_replace(F.coalesce("parameters", F.lit("")), "<[^<>]*>", "")
    text, notes = F.col("content"), F.concat_ws("\n", "annotations", "content")
    access = T.contains_any(text, STORES) | F.lower(F.col("owner")).rlike("(mapper|repository)")
    entry = F.concat_ws(" ", "endpoint", "symbol_name", "parameters", "annotations")
    return c.withColumn("owner", F.split_part("symbol_name", F.lit("#"), F.lit(1))).select(
        "id", "task_id", "owner", "analysis_scope", "change_type", "endpoint", "called_symbols", text.alias("content"),
        F.regexp_extract(method, "^[a-z]+", 0).alias("verb"), F.regexp_extract("owner", "^[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]*)?", 0).alias("entity"),
        F.when(F.trim(bare) == "", 0).otherwise(1 + F.regexp_count(bare, F.lit(","))).cast("int").alias("params"),
        T.contains_any(notes, ROLE_GUARDS).alias("guarded"), T.contains_any(text, OWNERS).alias("owned"), T.contains_any(text, rules.CLEANERS).alias("cleaned"),
        (T.matches(text, rules.DYNAMIC_SQL) & ~T.contains_any(text, SAFE_SQL)).alias("dynamic"),
        (access & T.contains_any(text, rules.LOOKUPS)).alias("by_id"), ((access & T.contains_any(text, MUTATES)) | T.contains_any(text, GATEWAYS)).alias("mutates"),
        T.contains_any(F.concat_ws(" ", entry, text), rules.SENSITIVE_ACTIONS).alias("sensitive"), T.contains_any(text, rules.SENSITIVE_DATA).alias("data"),
        T.matches(text, rules.RAW_HTML).alias("raw"), (T.contains_any(text, rules.VERIFIES) & T.matches(text, rules.BYPASS)).alias("bypass"),
        T.contains_any(F.concat_ws(" ", entry, text), [*rules.RESOURCE_IDS, " id"]).alias("resource"),
        T.contains_any(entry, rules.PUBLIC_CODE + rules.PUBLIC_ROUTES).alias("public"),
    ).distinct()


def _graded(nodes: DataFrame) -> DataFrame:
    """``(task_id, src, dst, called, line, verified, confidence)`` of every call that has a target, LOW ones as well.

    ``line`` is the first line of the caller that calls the name (1 if it is nowhere seen), ``verified`` whether the name is
    called there exactly once.
    """
    site = F.concat(F.lit(r"\b"), F.col("called"), F.lit(r"\w*\s*\("))
    calls = nodes.select("task_id", F.col("id").alias("src"), F.col("owner").alias("_owner"), "entity", "content", F.explode("called_symbols").alias("called")).where("called <> ''").distinct()
    before = F.substring("content", F.lit(1), F.greatest(F.regexp_instr("content", site) - 1, F.lit(0)))
    calls = calls.select("task_id", "src", "_owner", "entity", "called", (1 + T.newlines(before)).alias("line"), (F.regexp_count("content", site) == 1).alias("verified"))
    targets = nodes.select("task_id", "entity", F.col("verb").alias("called"), F.col("id").alias("dst"), "owner").where("entity <> ''")
    met = calls.join(targets, ["task_id", "entity", "called"]).where("src <> dst")
    several = F.count("*").over(Window.partitionBy("src", "called"))
    confidence = F.when(several == 1, "HIGH").when(F.col("_owner") == F.col("owner"), "MEDIUM").otherwise("LOW")
    return met.select("task_id", "src", "dst", "called", F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("verified", F.lit(False)).alias("verified"), confidence.alias("confidence"))


def _edges(nodes: DataFrame, both: bool = False) -> DataFrame:
    """Edges of the searches, one for each pair of methods, HIGH if one of its calls is; written once."""
    e = _graded(nodes).where("confidence <> 'LOW'").groupBy("task_id", "src", "dst").agg(F.min("confidence").alias("confidence"))
    return durable(G.both_ways(e) if both else e)


def _starts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("start"))


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All methods as starts, without what the searches ask of them."""
    c = table(spark, sf_dir, "code_chunk").where("id is not null and symbol_name like '%#%'")
    return c.select(F.col("id").alias("start")).distinct()


def _text(path: str = "path") -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(_nodes(spark, sf_dir))


def call_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each task, how many have a target, and the edges by confidence."""
    nodes = _nodes(spark, sf_dir)
    calls = nodes.select("task_id", "id", F.explode("called_symbols").alias("called")).where("called <> ''").distinct().groupBy("task_id").agg(F.count("*").alias("calls"))
    levels = [F.count_if(F.col("confidence") == v).alias(v.lower()) for v in ("HIGH", "MEDIUM", "LOW")]
    met = _graded(nodes).groupBy("task_id").agg(F.countDistinct("src", "called").alias("resolved"), *levels)
    return calls.join(met, "task_id", "left").na.fill(0)


def edge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_nodes(spark, sf_dir)).select("src", "dst", "confidence")


def graph_reach_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each method: what is within three calls of it, either way."""
    nodes = _nodes(spark, sf_dir)
    return G.reach(_edges(nodes, both=True), _all(spark, sf_dir), 3)


def graph_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of methods and their distance along calls, up to ten."""
    nodes = _nodes(spark, sf_dir)
    return G.reach(_edges(nodes), _all(spark, sf_dir), 10).where("hops > 0")


def graph_simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return G.simple_paths(_edges(nodes), _all(spark, sf_dir), 3).select("start", "node", "hops", _text().alias("path"))


def graph_explore(spark: SparkSession, sf_dir: str, quota: int = QUOTA) -> DataFrame:
    """Callees and callers of each method within two calls, at most ``quota`` paths each way: those of HIGH edges only
    first, then the shortest; ``verified`` paths have no other edges."""
    nodes = _nodes(spark, sf_dir)
    e = _edges(nodes)
    sure = {"verified": (F.lit(True), F.col("verified") & (F.col("confidence") == "HIGH"))}
    out = []
    for way, edges in (("OUT", e), ("IN", e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence"))):
        p = G.simple_paths(edges, _all(spark, sf_dir), 2, sure).withColumn("text", _text())
        rank = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("verified"), "hops", "text"))
        out.append(p.withColumn("place", rank).where(F.col("place") <= quota).select("start", F.lit(way).alias("direction"), "place", "verified", F.col("text").alias("path")))
    return out[0].unionByName(out[1])


def graph_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each endpoint reaches over HIGH edges alone, up to ten calls."""
    nodes = _nodes(spark, sf_dir)
    sure = _edges(nodes).where("confidence = 'HIGH'")
    return G.reach(sure, _starts(nodes.where("endpoint is not null")), 10).where("hops > 0")


def graph_component_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each changed method reaches, either way, stepping through impacted methods only."""
    nodes = _nodes(spark, sf_dir)
    impacted = nodes.where("analysis_scope = 'IMPACTED'").select(F.col("id").alias("dst"))
    return G.reach(_edges(nodes, both=True).join(impacted, "dst", "left_semi"), _starts(nodes.where("analysis_scope = 'CHANGED'")), 10).where("hops > 0")


def graph_reverse_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers, over any number of calls up to ten, of methods that change stored data, inside the changed and impacted ones:
    each with its fewest calls and the first (smallest) callee on such a way."""
    nodes = _nodes(spark, sf_dir)
    inside = nodes.where("analysis_scope in ('CHANGED', 'IMPACTED')").select("id")
    e = _edges(nodes).join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    sinks = nodes.where("mutates and analysis_scope in ('CHANGED', 'IMPACTED')")
    hops = G.reach(back, _starts(sinks), 10).groupBy("node").agg(F.min("hops").alias("hops"))
    near = e.join(hops.select(F.col("node").alias("src"), "hops"), "src").join(hops.select(F.col("node").alias("dst"), F.col("hops").alias("below")), "dst").where("hops = below + 1")
    return near.groupBy(F.col("src").alias("caller"), "hops").agg(F.min("dst").alias("via"))


def graph_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that a task's changes may touch: callees of added and modified methods, callers of renamed ones, within two calls."""
    nodes = _nodes(spark, sf_dir)
    e = _edges(nodes)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    target = G.reach(e, _starts(nodes.where("change_type in ('ADDED', 'MODIFIED')")), 2).withColumn("side", F.lit("TARGET"))
    base = G.reach(back, _starts(nodes.where("change_type in ('RENAMED', 'DELETED')")), 2).withColumn("side", F.lit("BASE"))
    return target.unionByName(base).where("hops > 0").groupBy("node", "side").agg(F.min("hops").alias("hops"), F.count("*").alias("changes"))


def graph_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from or to the changed and impacted methods of a task, with the side that is in scope."""
    nodes = _nodes(spark, sf_dir)
    scope = nodes.where("analysis_scope in ('CHANGED', 'IMPACTED')").select("id")
    e = _edges(nodes)
    e = e.join(scope.select(F.col("id").alias("src"), F.lit(True).alias("_out")), "src", "left").join(scope.select(F.col("id").alias("dst"), F.lit(True).alias("_in")), "dst", "left")
    side = F.when(F.col("_out") & F.col("_in"), "BOTH").when(F.col("_out"), "CALLER").when(F.col("_in"), "CALLEE")
    return e.select("src", "dst", side.alias("in_scope")).where("in_scope is not null")


def related_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one task whose pieces are related directly, by a call either way: pairs of pieces with findings on both."""
    nodes = _nodes(spark, sf_dir)
    f = table(spark, sf_dir, "finding").select("task_id", T.normal_path(F.col("file_path")).alias("path"), F.col("start_line").alias("at")).distinct()
    c = table(spark, sf_dir, "code_chunk").select("id", "task_id", T.normal_path(F.col("file_path")).alias("path"), "start_line", "end_line").distinct()
    held = c.join(f, ["task_id", "path"]).where("at between start_line and end_line").select("id").distinct()
    e = _edges(nodes).select("src", "dst")
    pair = e.select(F.least("src", "dst").alias("first_id"), F.greatest("src", "dst").alias("second_id")).distinct()
    for side in ("first_id", "second_id"):
        pair = pair.join(held.withColumnRenamed("id", side), side, "left_semi")
    return pair


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(start, node, risk, hops, path, confidence, gaps)`` of every state of the search that shows a risk.

    A path begins at a method with an endpoint, all whose parameters are tainted. A call taints all parameters of its target if
    any of the caller's is (edges carry no argument mapping), so taint is their number.
    """
    nodes = durable(_nodes(spark, sf_dir).drop("content", "called_symbols"))
    flags = ("params", "guarded", "owned", "cleaned")
    e = _edges(_nodes(spark, sf_dir)).join(nodes.select(F.col("id").alias("dst"), *(F.col(f).alias(f"d_{f}") for f in flags)), "dst")
    entries = nodes.where("endpoint is not null")
    starts = entries.select(F.col("id").alias("start"), *(F.col(f).alias(f"s_{f}") for f in flags))
    carry = {
        "taint": (F.col("s_params"), F.when(F.col("taint") > 0, F.col("d_params")).otherwise(0)),
        **{f"any_{f}": (F.col(f"s_{f}"), F.col(f"any_{f}") | F.col(f"d_{f}")) for f in flags[1:]},
        "gaps": (F.lit(0), F.col("gaps") + (F.col("confidence") == "MEDIUM").cast("int")),
    }
    states = G.simple_paths(e, starts, CALLS, carry, states=STATES, own=True)
    here = nodes.select(F.col("id").alias("node"), "dynamic", "by_id", "mutates", F.col("sensitive").alias("does"), "data", "raw", "bypass")
    entry = entries.select(F.col("id").alias("start"), "resource", "public", F.col("sensitive").alias("asks"))
    at = states.join(here, "node").join(entry, "start")
    c = F.col
    shown = {
        "SQL_INJECTION": c("dynamic") & (c("taint") > 0),
        "AUTHORIZATION_OWNER": c("resource") & c("by_id") & ~c("any_owned"),
        "AUTHORIZATION_ROLE": (c("asks") | c("does")) & c("mutates") & ~c("any_guarded"),
        "SENSITIVE_INFORMATION_DISCLOSURE": c("public") & c("data"),
        "STORED_XSS": c("raw") & ~c("any_cleaned"),
        "VALIDATION_BYPASS": c("bypass"),
    }
    risks = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in shown.items()]))
    confidence = F.when(c("gaps") == 0, "HIGH").otherwise("MEDIUM")
    return at.select("start", "node", F.explode(risks).alias("risk"), "hops", _text().alias("path"), confidence.alias("confidence"), "gaps")


def taint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state of the search that shows a risk."""
    return _flows(spark, sf_dir)


def best_path_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each entry and risk the flow that covers most calls, the first by text among equals; at most ``FLOWS`` an entry."""
    best = _flows(spark, sf_dir).groupBy("start", "risk").agg(F.min_by(F.struct("node", "hops", "path", "confidence", "gaps"), F.struct(-F.col("hops"), F.col("path"))).alias("b"))
    place = F.row_number().over(Window.partitionBy("start").orderBy("risk"))
    return best.withColumn("place", place).where(F.col("place") <= FLOWS).select("start", "risk", "b.*")


def effect_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of methods and of all that they call, to the fixpoint."""
    nodes = _nodes(spark, sf_dir)
    own = F.array_compact(F.array(*[F.when(F.col(k), F.lit(v)) for k, v in (("dynamic", "SQL"), ("by_id", "DIRECT_OBJECT_ACCESS"), ("mutates", "MUTATION"), ("guarded", "GUARD"))]))
    facts = nodes.select(F.col("id").alias("node"), F.explode(own).alias("fact"))
    return G.fixpoint(_edges(nodes), facts)


def anti_standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that render raw HTML and that no call leads to: flows of LOW confidence without a source."""
    e = _edges(_nodes(spark, sf_dir)).select(F.col("dst").alias("id"))
    c = table(spark, sf_dir, "code_chunk").where(T.matches(F.col("content"), rules.RAW_HTML)).select("id", "task_id").distinct()
    return c.join(e, "id", "left_anti").select("id", "task_id", F.lit("STORED_XSS").alias("risk"), F.lit("LOW").alias("confidence"))


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "audit_task").groupBy("id").agg(F.max_by(F.struct("project_id", "base_commit_sha", "target_commit_sha", "created_at"), "version").alias("t"))
    return t.select("id", "t.*")


def commit_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that each target commit descends from, with the fewest steps, up to eight."""
    t = _commits(spark, sf_dir)
    edges = t.where("base_commit_sha is not null and target_commit_sha is not null").select(F.col("target_commit_sha").alias("src"), F.col("base_commit_sha").alias("dst"))
    return G.reach(edges, t.where("target_commit_sha is not null").select(F.col("target_commit_sha").alias("start")), 8).where("hops > 0").groupBy("start").agg(F.count("*").alias("ancestors"), F.max("hops").alias("depth"))


def latest_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest distinct target commits of each project, with the tasks that saw them."""
    per = _commits(spark, sf_dir).where("target_commit_sha is not null").groupBy("project_id", "target_commit_sha").agg(F.unix_micros(F.max("created_at")).alias("seen_at"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("tasks"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("seen_at"), "target_commit_sha"))
    return per.withColumn("place", rank).where("place <= 3")


def merge_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For consecutive target commits of a project: the earlier one if the later descends from it, else their nearest
    common ancestor (fewest steps from both, then by name), else null."""
    t = _commits(spark, sf_dir).where("target_commit_sha is not null")
    later = F.lead("target_commit_sha").over(Window.partitionBy("project_id").orderBy("created_at", "id"))
    pairs = t.select("project_id", F.col("target_commit_sha").alias("base"), later.alias("target")).where("target is not null and target <> base").distinct()
    edges = t.where("base_commit_sha is not null").select(F.col("target_commit_sha").alias("src"), F.col("base_commit_sha").alias("dst"))
    up = durable(G.reach(edges, t.select(F.col("target_commit_sha").alias("start")), 8))
    held = pairs.join(up.select(F.col("start").alias("base"), F.col("node").alias("common"), F.col("hops").alias("up_base")), "base")
    met = held.join(up.select(F.col("start").alias("target"), F.col("node").alias("common"), F.col("hops").alias("up_target")), ["target", "common"])
    best = met.groupBy("project_id", "base", "target").agg(F.min_by("common", F.struct(F.when(F.col("common") == F.col("base"), 0).otherwise(1), F.col("up_base") + F.col("up_target"), F.col("common"))).alias("merge_base"))
    return pairs.join(best, ["project_id", "base", "target"], "left")


QUERIES = {
    f.__name__: f
    for f in (
        call_edges, call_coverage, edge_confidence, graph_reach_d, graph_hops, graph_simple_paths, graph_explore, graph_verified,
        graph_component_guarded, graph_reverse_first, graph_impact, graph_topology, related_pieces, taint_paths, best_path_per_key,
        effect_fixpoint, anti_standalone, commit_ancestry, merge_bases, latest_commits,
    )
}

_ENTRY = "concat_ws(' ', endpoint, symbol_name, parameters, annotations)"
_NOTED = "concat_ws(chr(10), annotations, content)"
_BOTH = f"concat_ws(' ', {_ENTRY}, content)"
_ACCESS = "(" + _any("content", STORES) + " or regexp_matches(lower(owner), '(mapper|repository)'))"
_N = f"""n as materialized (select distinct id, task_id, owner, analysis_scope, change_type, endpoint, called_symbols, content,
    regexp_extract(split_part(symbol_name, '#', 2), '^[a-z]+') as verb, regexp_extract(owner, '^[A-Z][a-z0-9]*(?:[A-Z][a-z0-9]*)?') as entity,
    case when trim(bare) = '' then 0 else 1 + length(bare) - length(replace(bare, ',', '')) end as params,
    {_any(_NOTED, ROLE_GUARDS)} as guarded, {_any("content", OWNERS)} as owned, {_any("content", rules.CLEANERS)} as cleaned,
    {_matches("content", rules.DYNAMIC_SQL)} and not {_any("content", SAFE_SQL)} as dynamic, {_ACCESS} and {_any("content", rules.LOOKUPS)} as by_id,
    ({_ACCESS} and {_any("content", MUTATES)}) or {_any("content", GATEWAYS)} as mutates, {_any(_BOTH, rules.SENSITIVE_ACTIONS)} as sensitive,
    {_any("content", rules.SENSITIVE_DATA)} as data, {_matches("content", rules.RAW_HTML)} as raw,
    {_any("content", rules.VERIFIES)} and {_matches("content", _BYPASS_RE2)} as bypass, {_any(_BOTH, [*rules.RESOURCE_IDS, " id"])} as resource,
    {_any(_ENTRY, rules.PUBLIC_CODE + rules.PUBLIC_ROUTES)} as public
  from (select *, split_part(symbol_name, '#', 1) as owner, regexp_replace(coalesce(parameters, ''), '<[^<>]*>', '', 'g') as bare from code_chunk
    where id is not null and symbol_name like '%#%'))"""
_SITE = r"'\b' || called || '\w*\s*\('"
_CALLS = f"""{_N}, c as (select distinct task_id, id as src, owner, entity, content, called from (select *, unnest(called_symbols) as called from n) where called <> ''),
  k as materialized (select c.task_id, c.src, t.id as dst, c.called, regexp_matches(coalesce(c.content, ''), {_SITE.replace("called", "c.called")}) as seen, c.content, c.owner = t.owner as own,
      count(*) over (partition by c.src, c.called) as several
    from c join n t on t.task_id = c.task_id and t.verb = c.called and t.entity = c.entity and t.id <> c.src where c.entity <> ''),
  g as materialized (select task_id, src, dst, called, case when seen then 1 + len(regexp_extract_all(regexp_extract(content, '(?s)^(.*?)' || {_SITE}, 1), chr(10))) else 1 end as line,
      len(regexp_extract_all(coalesce(content, ''), {_SITE})) = 1 as verified, case when several = 1 then 'HIGH' when own then 'MEDIUM' else 'LOW' end as confidence from k)"""
_E = f"{_CALLS}, e as materialized (select task_id, src, dst, min(confidence) as confidence from g where confidence <> 'LOW' group by 1, 2, 3)"
_B = "b as (select src, dst from e union select dst, src from e)"


def _reach(edges: str, starts: str, depth: int, name: str = "w") -> str:
    return f"{name} as (select id as start, id as node, 0 as hops from {starts} union select {name}.start, x.dst, {name}.hops + 1 from {name} join {edges} x on x.src = {name}.node where {name}.hops < {depth})"


_LEAST = "select start, node, min(hops) as hops from w group by 1, 2"
_FLOWS = f"""with recursive {_E}, p as (select id as start, id as node, [id] as path, 0 as hops, params as taint, guarded, owned, cleaned, 0 as gaps from n where endpoint is not null
  union all select p.start, e.dst, list_append(p.path, e.dst), p.hops + 1, case when p.taint > 0 then d.params else 0 end, p.guarded or d.guarded, p.owned or d.owned, p.cleaned or d.cleaned, p.gaps + (e.confidence = 'MEDIUM')::int
    from p join e on e.src = p.node and not list_contains(p.path, e.dst) join n d on d.id = e.dst where p.hops < 10),
  s as (select p.start, p.node, p.hops, array_to_string(p.path, '>') as path, case when gaps = 0 then 'HIGH' else 'MEDIUM' end as confidence, gaps,
      unnest(list_filter([case when h.dynamic and taint > 0 then 'SQL_INJECTION' end, case when a.resource and h.by_id and not p.owned then 'AUTHORIZATION_OWNER' end,
        case when (a.sensitive or h.sensitive) and h.mutates and not p.guarded then 'AUTHORIZATION_ROLE' end, case when a.public and h.data then 'SENSITIVE_INFORMATION_DISCLOSURE' end,
        case when h.raw and not p.cleaned then 'STORED_XSS' end, case when h.bypass then 'VALIDATION_BYPASS' end], lambda x: x is not null)) as risk
    from p join n h on h.id = p.node join n a on a.id = p.start)"""
_COMMITS = "t as (select id, arg_max(project_id, version) as project_id, arg_max(base_commit_sha, version) as base_commit_sha, arg_max(target_commit_sha, version) as target_commit_sha, arg_max(created_at, version) as created_at from audit_task group by id)"
SQL = {
    "call_edges": f"with {_CALLS} select * from g",
    "call_coverage": f"""with {_CALLS}, t as (select task_id, count(*) as calls from (select distinct task_id, src, called from c) group by 1),
      m as (select task_id, count(distinct (src, called)) as resolved, count(*) filter (confidence = 'HIGH') as high, count(*) filter (confidence = 'MEDIUM') as medium, count(*) filter (confidence = 'LOW') as low from g group by 1)
      select task_id, calls, coalesce(resolved, 0) as resolved, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(low, 0) as low from t left join m using (task_id)""",
    "edge_confidence": f"with {_E} select src, dst, confidence from e",
    "graph_reach_d": f"with recursive {_E}, {_B}, {_reach('b', 'n', 3)} {_LEAST}",
    "graph_hops": f"with recursive {_E}, {_reach('e', 'n', 10)} {_LEAST} having min(hops) > 0",
    "graph_simple_paths": f"""with recursive {_E}, p as (select id as start, id as node, [id] as path, 0 as hops from n union all
      select p.start, e.dst, list_append(p.path, e.dst), p.hops + 1 from p join e on e.src = p.node and not list_contains(p.path, e.dst) where p.hops < 3)
      select start, node, hops, array_to_string(path, '>') as path from p where hops > 0""",
    "graph_explore": f"""with recursive {_E}, d as (select src, dst, confidence, 'OUT' as direction from e union all select dst, src, confidence, 'IN' from e),
      p as (select id as start, id as node, [id] as path, 0 as hops, direction, true as verified from n, (values ('OUT'), ('IN')) v(direction) union all
      select p.start, d.dst, list_append(p.path, d.dst), p.hops + 1, p.direction, p.verified and d.confidence = 'HIGH' from p join d on d.src = p.node and d.direction = p.direction and not list_contains(p.path, d.dst) where p.hops < 2)
      select * from (select start, direction, row_number() over (partition by start, direction order by verified desc, hops, array_to_string(path, '>')) as place, verified, array_to_string(path, '>') as path from p where hops > 0) where place <= 4""",
    "graph_verified": f"with recursive {_E}, q as (select * from e where confidence = 'HIGH'), {_reach('q', '(select id from n where endpoint is not null)', 10)} {_LEAST} having min(hops) > 0",
    "graph_component_guarded": f"""with recursive {_E}, {_B}, q as (select * from b where dst in (select id from n where analysis_scope = 'IMPACTED')),
      {_reach('q', "(select id from n where analysis_scope = 'CHANGED')", 10)} {_LEAST} having min(hops) > 0""",
    "graph_reverse_first": f"""with recursive {_E}, i as (select id from n where analysis_scope in ('CHANGED', 'IMPACTED')), f as (select * from e where src in (from i) and dst in (from i)), r as (select dst as src, src as dst from f),
      {_reach('r', "(select id from n where mutates and id in (from i))", 10)}, h as (select node, min(hops) as hops from w group by 1)
      select f.src as caller, a.hops, min(f.dst) as via from f join h a on a.node = f.src join h z on z.node = f.dst where a.hops = z.hops + 1 group by 1, 2""",
    "graph_impact": f"""with recursive {_E}, r as (select dst as src, src as dst from e), {_reach('e', "(select id from n where change_type in ('ADDED', 'MODIFIED'))", 2)},
      {_reach('r', "(select id from n where change_type in ('RENAMED', 'DELETED'))", 2, 'v')},
      m as (select start, node, 'TARGET' as side, min(hops) as hops from w group by 1, 2 union all select start, node, 'BASE', min(hops) from v group by 1, 2)
      select node, side, min(hops) as hops, count(*) as changes from m where hops > 0 group by 1, 2""",
    "graph_topology": f"""with {_E}, s as (select id from n where analysis_scope in ('CHANGED', 'IMPACTED'))
      select src, dst, case when o and i then 'BOTH' when o then 'CALLER' else 'CALLEE' end as in_scope from (select src, dst, src in (from s) as o, dst in (from s) as i from e) where o or i""",
    "related_pieces": f"""with {_E}, f as (select distinct task_id, {_PATH.format("file_path")} as path, start_line as at from finding),
      h as (select distinct c.id from (select *, {_PATH.format("file_path")} as path from code_chunk) c join f on f.task_id = c.task_id and f.path = c.path and f.at between c.start_line and c.end_line)
      select distinct least(src, dst) as first_id, greatest(src, dst) as second_id from e where src in (from h) and dst in (from h)""",
    "taint_paths": _FLOWS + " select * from s",
    "best_path_per_key": _FLOWS + " select start, risk, node, hops, path, confidence, gaps from (select *, row_number() over (partition by start, risk order by hops desc, path) as k from s) where k = 1",
    "effect_fixpoint": f"""with recursive {_E}, w as (select id as node, unnest(list_filter([case when dynamic then 'SQL' end, case when by_id then 'DIRECT_OBJECT_ACCESS' end, case when mutates then 'MUTATION' end, case when guarded then 'GUARD' end], lambda x: x is not null)) as fact from n
      union select e.src, w.fact from w join e on e.dst = w.node) select * from w""",
    "anti_standalone": f"with {_E} select distinct id, task_id, 'STORED_XSS' as risk, 'LOW' as confidence from code_chunk where {_matches('content', rules.RAW_HTML)} and id not in (select dst from e)",
    "merge_bases": f"""with recursive {_COMMITS}, w as (select distinct target_commit_sha as start, target_commit_sha as node, 0 as hops from t where target_commit_sha is not null union select w.start, t.base_commit_sha, w.hops + 1 from w join t on t.target_commit_sha = w.node where t.base_commit_sha is not null and w.hops < 8),
      u as (select start, node, min(hops) as hops from w group by 1, 2),
      p as (select distinct * from (select project_id, target_commit_sha as base, lead(target_commit_sha) over (partition by project_id order by created_at, id) as target from t where target_commit_sha is not null) where target <> base),
      m as (select p.*, b.node as common, row_number() over (partition by p.project_id, p.base, p.target order by b.node <> p.base, b.hops + a.hops, b.node) as k from p join u b on b.start = p.base join u a on a.start = p.target and a.node = b.node)
      select p.*, m.common as merge_base from p left join m on m.k = 1 and m.project_id = p.project_id and m.base = p.base and m.target = p.target""",
    "commit_ancestry": f"""with recursive {_COMMITS}, w as (select distinct target_commit_sha as start, target_commit_sha as node, 0 as hops from t where target_commit_sha is not null union select w.start, t.base_commit_sha, w.hops + 1 from w join t on t.target_commit_sha = w.node where t.base_commit_sha is not null and w.hops < 8),
      m as (select start, node, min(hops) as hops from w group by 1, 2) select start, count(*) as ancestors, max(hops) as depth from m where hops > 0 group by start""",
    "latest_commits": f"""with {_COMMITS}, p as (select project_id, target_commit_sha, epoch_us(max(created_at)) as seen_at, string_agg(distinct id, ',' order by id) as tasks from t where target_commit_sha is not null group by 1, 2)
      select * from (select *, row_number() over (partition by project_id order by seen_at desc, target_commit_sha) as place from p) where place <= 3""",
}
