"""Queries on file roles, lines, rules and fingerprints of code pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatewing.functions import text as T
from slatewing.operators import rules
from slatewing.session import small_side, spread, table
from slatewing.sources import roles


def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _any(expr: str, tokens: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({expr}, '')), '{t.lower()}')" for t in tokens) + ")"


def _matches(expr: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({expr}, ''), '{pattern}', 'is')"


_PATH = r"regexp_replace(regexp_replace(regexp_replace(trim(coalesce({0}, '')), '\\', '/', 'g'), '/+', '/', 'g'), '^(?:\./)+', '')"


def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.lines(F.col("content"))
    return table(spark, sf_dir, "code_chunk").where("content is not null").select(
        "id",
        F.size(rows).alias("line_count"),
        F.size(F.filter(rows, lambda x: F.trim(x) == "")).alias("blank_lines"),
        F.array_max(F.transform(rows, F.length)).alias("longest_line"),
    ).distinct()


def file_role_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "code_chunk").select(F.col("file_path").alias("path"))
    changes = table(spark, sf_dir, "git_file_change").select(F.explode(F.array("old_path", "new_path")).alias("path"))
    paths = chunks.unionByName(changes).where("path is not null").distinct()
    role = roles.file_role(F.col("path"))
    return paths.select(
        "path", role.alias("role"), roles.framework_context(F.col("path")).alias("framework_context"),
        role.isin("JAVA_SOURCE", "DATA_ACCESS", "SECURITY_CONFIGURATION", "SERVER_TEMPLATE").alias("creates_chunks"),
    )


_ROLE = f"""
  case when p = '' or len(list_filter(string_split(whole, '/'), lambda x: x in ({_sql_list(roles.EXCLUDED)}))) > 0
      or (case when name like '%.java' then regexp_matches(name, '{roles.TEST_TYPES}') else regexp_matches(low, '{roles.TEST_NAMES}') end)
      or regexp_matches(low, '{roles.GENERATED}') then 'IGNORE'
    when regexp_matches(low, '{roles.BUILD}') then 'BUILD_METADATA'
    when low like '%.java' then 'JAVA_SOURCE'
    when regexp_matches(low, '{roles.CONFIGURATION}') then 'SECURITY_CONFIGURATION'
    when low like '%.sql' or regexp_matches(low, '{roles.DATA_XML_NAMES}') or regexp_matches(whole, '{roles.DATA_XML_PLACES}') then 'DATA_ACCESS'
    when regexp_matches(low, '{roles.SECURITY_XML_NAMES}') or regexp_matches(whole, '{roles.SECURITY_XML_PLACES}') then 'SECURITY_CONFIGURATION'
    when regexp_matches(low, '{roles.TEMPLATES}') or regexp_matches(whole, '{roles.TEMPLATE_PLACES}') then 'SERVER_TEMPLATE'
    else 'IGNORE' end"""


def _roles_of(source: str) -> str:
    return f"""(select *, {_ROLE} as role from (select *, lower(name) as low, lower(p) as whole from (
      select *, regexp_extract(p, '[^/]*$') as name from (select *, {_PATH.format("path")} as p from ({source})))))"""


def framework_files(spark: SparkSession, sf_dir: str, files: int = 40, each: int = 24_000, total: int = 120_000) -> DataFrame:
    """Framework files of each task by priority, with a running budget of characters; the file that
    exhausts it is kept in part."""
    path = T.normal_path(F.col("file_path"))
    rows = (
        table(spark, sf_dir, "code_chunk")
        .where(roles.framework_context(F.col("file_path")) & F.col("content").isNotNull())
        .groupBy("task_id", path.alias("path"))
        .agg(F.max(F.least(F.length("content"), F.lit(each))).alias("size"))
        .withColumn("priority", F.when(roles.file_role(F.col("path")) == "BUILD_METADATA", 0).when(F.col("path").contains("application"), 1).otherwise(2))
    )
    order = Window.partitionBy("task_id").orderBy("priority", "path")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        rows.select("task_id", "path", "priority", F.row_number().over(order).alias("place"), F.least(F.col("size"), F.greatest(F.lit(total) - before, F.lit(0))).cast("long").alias("used"))
        .where(f"place <= {files} and used > 0")
    )


def keyword_filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "code_chunk")
    return c.where(T.contains_any(F.col("content"), rules.SENSITIVE_DATA)).select("id", "file_path", "chunk_type").distinct()


def regex_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "code_chunk").where(T.matches(F.col("content"), rules.DYNAMIC_SQL))
    return c.select("id", T.first_match_line(F.col("content"), rules.DYNAMIC_SQL, F.col("start_line")).cast("long").alias("line_no")).distinct()


def excerpt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = T.first_match_line(F.col("content"), rules.DYNAMIC_SQL, F.col("start_line"))
    c = table(spark, sf_dir, "code_chunk").where(T.matches(F.col("content"), rules.DYNAMIC_SQL))
    return c.select("id", T.excerpt(F.col("content"), F.col("start_line"), line).alias("excerpt")).distinct()


def rule_scan_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan(spread(table(spark, sf_dir, "code_chunk").select("id", "task_id", "file_path", "symbol_name", "endpoint", "start_line", "content")))


#: RE2 has no lookahead: what may follow ``;\s*`` without being ``if`` directly behind the semicolon or blanks.
_BYPASS_RE2 = rules.BYPASS.replace(r";\s*(?!if)", r";(?:\s|[^i\s]|i[^f]|i?$)")


def _line_sql(pattern: str) -> str:
    part = f"regexp_extract(coalesce(content, ''), '(?i)^(?s:(.*?))(?:{pattern})', 1)"
    hit = f"regexp_matches(coalesce(content, ''), '(?i)(?:{pattern})')"
    return f"(start_line + case when {hit} then length({part}) - length(replace({part}, chr(10), '')) else 0 end)::int"


def _rule_sql() -> str:
    conditions = {
        "dynamic_sql": (_matches("content", rules.DYNAMIC_SQL), _line_sql(rules.DYNAMIC_SQL)),
        "direct_object_access": (
            "endpoint is not null and " + _any("endpoint || coalesce(content, '')", rules.RESOURCE_IDS) + " and " + _any("content", rules.LOOKUPS) + " and not " + _any("content", rules.OWNERSHIP),
            _line_sql(rules.BY_ID),
        ),
        "missing_role": ("endpoint is not null and " + _any("endpoint || ' ' || coalesce(symbol_name, 'null')", rules.SENSITIVE_ACTIONS) + " and not " + _any("content", rules.GUARDS), "start_line"),
        "public_sensitive": ("endpoint is not null and (" + _any("content", rules.PUBLIC_CODE) + " or " + _any("endpoint", rules.PUBLIC_ROUTES) + ") and " + _any("content", rules.SENSITIVE_DATA), _line_sql(rules.SENSITIVE_FIELD)),
        "raw_html": (_matches("content", rules.RAW_HTML), _line_sql(rules.RAW_HTML)),
        "stored_text": ("not " + _matches("content", rules.RAW_HTML) + " and " + _any("content", rules.PERSISTS) + " and " + _any("content", rules.FREE_TEXT) + " and not " + _any("content", rules.CLEANERS), _line_sql(rules.STORES)),
        "validation_bypass": (_any("content", rules.VERIFIES) + " and " + _matches("content", _BYPASS_RE2), _line_sql(_BYPASS_RE2)),
    }
    return " union ".join(
        f"select id, task_id, file_path, '{r.name}' as rule, '{r.type}' as type, '{r.severity}' as severity, '{r.confidence}' as confidence, {conditions[r.name][1]} as line from code_chunk where {conditions[r.name][0]}"
        for r in rules.RULES
    )


def rule_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per code piece: its types and rules, each as one sorted text (hints for reviewers)."""
    hits = rule_scan_union(spark, sf_dir)
    joined = {n: F.array_join(F.array_sort(F.collect_set(c)), ",") for n, c in (("types", "type"), ("rules", "rule"))}
    return hits.groupBy("id").agg(*[v.alias(k) for k, v in joined.items()])


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable identity of each rule result: type, path, symbol and the code around the line."""
    c = spread(table(spark, sf_dir, "code_chunk").where("content is not null").select("id", "file_path", "symbol_name", "endpoint", "start_line", "content"))
    hits = rules.scan(c, keep=("id", "file_path", "symbol_name", "start_line", "content"))
    bare = F.transform(T.lines(F.col("content")), T.without_blanks)
    at = F.col("line") - F.col("start_line")
    own = F.element_at("bare", (at + 1).cast("int"))
    window = F.filter(F.slice("bare", F.greatest(at, F.lit(1)).cast("int"), (F.when(at == 0, 2).otherwise(3)).cast("int")), lambda x: x != "")
    earlier = F.size(F.filter(F.slice("bare", F.lit(1), F.greatest(at, F.lit(0)).cast("int")), lambda x: x == own))
    occurrence = F.when(own == "", 1).otherwise(earlier + 1)
    anchor = F.concat(F.sha2(F.array_join(window, "\n"), 256), F.lit(":occurrence:"), occurrence.cast("string"))
    key = F.concat_ws("|", "type", T.normal_path(F.col("file_path")), F.regexp_replace(F.coalesce("symbol_name", F.lit("")), r"\s+", ""), anchor)
    return hits.withColumn("bare", bare).select("id", "rule", "line", F.sha2(key, 256).alias("fingerprint")).distinct()


_BARE = r"""regexp_replace(x, '("(?:\\.|[^"\\])*"?|''(?:\\.|[^''\\])*''?)|\s+', '\1', 'g')"""


def changed_secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key armor, addresses with passwords, known token formats, XML elements and assignments with a literal secret on
    changed lines.

    Comment lines are left out; a whole added file counts as changed. The hint is what stands before the first colon or equals
    sign; where that would hold the secret, or there is none, it names the kind alone.
    """
    change = (
        table(spark, sf_dir, "git_file_change")
        .where("new_path is not null")
        .groupBy("task_id", T.normal_path(F.col("new_path")).alias("path"))
        .agg(F.max_by(F.struct("new_ranges", "change_type"), "id").alias("g"))
    )
    c = table(spark, sf_dir, "code_chunk").where("analysis_scope = 'CHANGED' and content is not null").select("id", "task_id", T.normal_path(F.col("file_path")).alias("path"), "start_line", "content")
    c = c.withColumn("configuration", roles.file_role(F.col("path")).isin("SECURITY_CONFIGURATION", "DATA_ACCESS"))
    lined = c.join(change, ["task_id", "path"]).select("id", "start_line", "configuration", "g", F.posexplode(T.lines(F.col("content"))).alias("pos", "raw"))
    lined = lined.select("id", (F.col("start_line") + F.col("pos")).alias("line_no"), "configuration", "g", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("line"))
    ranges = F.coalesce("g.new_ranges", F.array().cast("array<struct<start:int,end:int>>"))
    inside = F.exists(ranges, lambda r: (F.col("line_no") >= r["start"]) & (F.col("line_no") <= r["end"]))
    whole = (F.size(ranges) == 0) & (F.col("g.change_type") == "ADD")
    # what all patterns need, asked first
    some = F.col("line").rlike(r"(?i)-----BEGIN|:/|AKIA|gh[pousr]_|sk-|passw|pwd|secret|key|token|credential")
    found = lined.where(some & (inside | whole) & (F.col("line") != "") & ~F.col("line").rlike(r"^(?:#|//)")).withColumn("kind", secret_kind(F.col("line"), F.col("configuration")))
    return found.where("kind is not null").select("id", "line_no", "kind", secret_hint(F.col("line"), F.col("kind")).alias("hint")).distinct()


#: Armor, address, token, element and assignment patterns of the line scanner, and values that are none.
_ARMOR = r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"
_ADDRESS = r"(?i)(?:jdbc:[a-z0-9]+:|https?|redis|mongodb(?:\+srv)?):/{1,2}[^\s/:@]+:([^\s@/]+)@"
_KNOWN = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,})"
_ELEMENT = r"(?i)<(password|passwd|pwd|secret|apiKey|accessKey|secretKey|privateKey|clientSecret|token|credential)>\s*([^<]+)\s*</\1>"
_ASSIGNED = r"""(?i)["']?[a-z0-9_.-]*(?:password|passwd|pwd|secret|api[-_.]?key|access[-_.]?key|secret[-_.]?key|private[-_.]?key|client[-_.]?secret|access[-_.]?token|refresh[-_.]?token|auth[-_.]?token|credential)[a-z0-9_.-]*["']?\s*[:=]\s*(\S.*?)\s*(?:,\s*)?(?: #.*)?$"""
_STAND_IN = r"""(?i)^["']?\s*(?:\$\{[^}:]+:?\}|<[^>]+>|test|sample)?\s*["']?$|^["']?\s*#\{|placeholder|example-value|dummy-value|your-"""
_NO_LITERAL = r"(?i)^(?:null|none|true|false)$|^(?:enc\(|\{cipher\}|classpath:)|system\.get(?:env|property)"
_WRITTEN = rf"^[\"']|{_KNOWN}"


def _literal(value: Column) -> Column:
    return ~value.rlike(_NO_LITERAL) & ~value.rlike(_STAND_IN)


def secret_kind(line: Column, configuration: Column) -> Column:
    """What kind of secret a line writes out, or null. A value counts if it is quoted, a known token, or anything in a
    configuration file, unless it is a stand-in, encrypted or looked up."""
    value = F.regexp_extract(line, _ASSIGNED, 1)
    return (
        F.when(line.rlike(_ARMOR), "PRIVATE_KEY")
        .when(line.rlike(_ADDRESS), "ADDRESS")
        .when(line.rlike(_KNOWN) & ~line.rlike(_STAND_IN), "TOKEN")
        .when(line.rlike(_ELEMENT) & _literal(F.trim(F.regexp_extract(line, _ELEMENT, 2))), "ELEMENT")
        .when(_literal(value) & (configuration | value.rlike(_WRITTEN)), "ASSIGNMENT")
    )


def secret_hint(line: Column, kind: Column) -> Column:
    prefix = F.regexp_extract(line, r"^([^:=]*)[:=]", 1)
    bare = line.rlike("[:=]") & (kind == "ASSIGNMENT") & ~prefix.rlike(_KNOWN)
    return F.when(bare, F.concat(prefix, F.lit(": <REDACTED_LITERAL>"))).otherwise(F.concat(F.lit("<REDACTED_"), kind, F.lit(">")))


def mapper_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of mapper files: namespace, kind, id, and whether text is spliced into the SQL."""
    c = table(spark, sf_dir, "code_chunk").where("lower(file_path) like '%.xml' and content like '%<mapper%'")
    pattern = r"(?is)<(select|insert|update|delete)\b[^>]*\bid\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</\1>"
    space = F.regexp_extract("content", r"(?is)<mapper\s+[^>]*namespace\s*=\s*[\"']([^\"']+)[\"']", 1)
    each = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "kind"), (2, "name"), (3, "body"))])
    return c.select("id", space.alias("namespace"), F.explode(each).alias("s")).select(
        "id", "namespace", F.lower("s.kind").alias("kind"), F.col("s.name").alias("statement_id"), F.contains(F.col("s.body"), F.lit("${")).alias("spliced")
    ).distinct()


def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = T.normal_path(F.col("file_path"))
    return table(spark, sf_dir, "code_chunk").select(path.alias("path")).where(F.col("path").rlike(T.glob_pattern("**/resources/**/*.xml"))).groupBy("path").agg(F.count("*").alias("deliveries"))


_POLICIES = [("/api/*/*/{id}/*", "by_id"), ("/api/{zone}/**", "zone"), ("/api/*/*/*/export", "export"), ("/admin/**", "admin")]


def route_pattern_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = spark.createDataFrame(_POLICIES, "pattern string, policy string")
    routes = table(spark, sf_dir, "code_chunk").where("endpoint is not null").select("endpoint").distinct()
    return routes.join(small_side(policies.withColumn("re", T.route_pattern(F.col("pattern")))), F.expr("endpoint rlike re")).select("endpoint", "policy")


def symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "code_chunk").where("symbol_name is not null")
    mapped = F.regexp_extract("annotations", r"@(\w+)", 1)
    return c.groupBy(T.simple_name(F.col("symbol_name")).alias("simple_name"), T.enum_name(mapped).alias("annotation"), T.joined_endpoint(F.lit("/v1/"), F.col("endpoint")).alias("route")).agg(
        F.countDistinct("id").alias("pieces")
    )


def code_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of its tokens each changed piece shares with its older version."""
    c = table(spark, sf_dir, "code_chunk").where("change_type in ('MODIFIED', 'RENAMED') and chunk_type = 'METHOD'")
    return c.select("id", F.round(T.jaccard(T.tokens(F.col("content")), T.tokens(F.col("base_content"))), 6).alias("similarity")).distinct()


def guards_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guard words that a change added to or removed from a piece."""
    c = table(spark, sf_dir, "code_chunk").where("base_content is not null and base_content <> '' and content is not null")
    words = F.array(*[F.lit(w) for w in rules.GUARDS + rules.OWNERSHIP])

    def held(text: str):
        return F.filter(words, lambda w: F.contains(F.lower(text), w))

    added = F.array_except(held("content"), held("base_content"))
    removed = F.array_except(held("base_content"), held("content"))
    return c.select("id", F.array_join(F.array_sort(added), ",").alias("guards_added"), F.array_join(F.array_sort(removed), ",").alias("guards_removed")).where("guards_added <> '' or guards_removed <> ''").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        line_scan, file_role_classify, framework_files, keyword_filter_any, regex_first_line, excerpt_window, rule_scan_union,
        rule_hints, fingerprint, changed_secret_lines, mapper_statements, glob_filter, route_pattern_join, symbol_names,
        code_similarity, guards_diff,
    )
}

_RULES = f"with hits as ({_rule_sql()}) "
_EXCERPT = _line_sql(rules.DYNAMIC_SQL)
_GUARD_LIST = f"[{_sql_list(rules.GUARDS + rules.OWNERSHIP)}]"
_CLEAN_SQL = "trim(regexp_replace(trim(regexp_replace(trim({0}), ' #.*$', '')), ',$', ''))"
_STAND_IN_SQL = "(regexp_matches(lower(trim({0})), '^\\$\\{{[^}}:]+:?\\}}$') or starts_with(lower(trim({0})), '#{{') or regexp_matches(trim({0}), '^<[^>]+>$') or regexp_matches(lower({0}), 'placeholder|example-value|dummy-value|your-') or lower(trim({0})) in ('test', 'sample'))"
_BARE_SQL = "trim(regexp_replace({0}, '^[\"'']|[\"'']$', '', 'g'))"
_LITERAL_SQL = (
    "({0} <> '' and not " + _STAND_IN_SQL + " and lower({0}) not in ('null', 'none', 'true', 'false') and not regexp_matches(lower({0}), '^(enc\\(|\\{{cipher\\}}|classpath:)')"
    " and not regexp_matches(lower({0}), 'system\\.(getenv|getproperty)') and ({1} or regexp_matches({0}, '^[\"'']') or regexp_matches({0}, 'AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{20,}}|sk-[A-Za-z0-9_-]{{20,}}'))"
    " and " + _BARE_SQL + " <> '' and not " + _STAND_IN_SQL.replace("{0}", "trim(regexp_replace({0}, '^[\"'']|[\"'']$', '', 'g'))") + ")"
)
_LINES = r"regexp_split_to_array(content, '\r\n|\n|\r')"
_SETS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9_]+'), lambda x: length(x) > 0))"
SQL = {
    "line_scan": f"""select distinct id, len(r) as line_count, len(list_filter(r, lambda x: trim(x) = '')) as blank_lines, list_max(list_transform(r, lambda x: length(x))) as longest_line
      from (select id, {_LINES} as r from code_chunk where content is not null)""",
    "file_role_classify": f"""select path, role, role = 'BUILD_METADATA' or (role = 'SECURITY_CONFIGURATION' and regexp_matches(low, '{roles.FRAMEWORK}')) as framework_context,
      role in ('JAVA_SOURCE', 'DATA_ACCESS', 'SECURITY_CONFIGURATION', 'SERVER_TEMPLATE') as creates_chunks
      from {_roles_of("select file_path as path from code_chunk where file_path is not null union select old_path from git_file_change where old_path is not null union select new_path from git_file_change where new_path is not null")}""",
    "framework_files": f"""with f as (select task_id, p as path, max(least(length(content), 24000)) as size, any_value(case when role = 'BUILD_METADATA' then 0 when contains(p, 'application') then 1 else 2 end) as priority
        from {_roles_of("select *, file_path as path from code_chunk where content is not null")}
        where role = 'BUILD_METADATA' or (role = 'SECURITY_CONFIGURATION' and regexp_matches(low, '{roles.FRAMEWORK}')) group by task_id, p),
      b as (select *, row_number() over w as place, coalesce(sum(size) over (partition by task_id order by priority, path rows between unbounded preceding and 1 preceding), 0) as before from f window w as (partition by task_id order by priority, path))
      select task_id, path, priority, place, least(size, greatest(120000 - before, 0))::bigint as used from b where place <= 40 and least(size, greatest(120000 - before, 0)) > 0""",
    "keyword_filter_any": f"select distinct id, file_path, chunk_type from code_chunk where {_any('content', rules.SENSITIVE_DATA)}",
    "regex_first_line": f"select distinct id, {_line_sql(rules.DYNAMIC_SQL)}::bigint as line_no from code_chunk where {_matches('content', rules.DYNAMIC_SQL)}",
    "excerpt_window": f"""select distinct id, array_to_string(list_transform(range(greatest(l - start_line - 2, 0), least(l - start_line + 2, len(r) - 1) + 1), lambda i: (start_line + i)::varchar || ' | ' || r[i + 1]), chr(10)) as excerpt
      from (select id, start_line, {_EXCERPT} as l, {_LINES} as r from code_chunk where {_matches('content', rules.DYNAMIC_SQL)})""",
    "rule_scan_union": _rule_sql(),
    "rule_hints": _RULES + "select id, string_agg(distinct type, ',' order by type) as types, string_agg(distinct rule, ',' order by rule) as rules from hits group by id",
    "fingerprint": _RULES
    + f"""select distinct id, rule, line, sha256(type || '|' || {_PATH.format("file_path")} || '|' || regexp_replace(coalesce(symbol_name, ''), '\\s+', '', 'g') || '|'
        || sha256(array_to_string(list_filter(list_slice(bare, greatest(off, 1), off + 2), lambda x: x <> ''), chr(10))) || ':occurrence:'
        || (case when bare[off + 1] = '' then 1 else len(list_filter(list_slice(bare, 1, off), lambda x: x = bare[off + 1])) + 1 end)::varchar) as fingerprint
      from (select h.*, c.symbol_name, h.line - c.start_line as off, list_transform({_LINES.replace("content", "c.content")}, lambda x: {_BARE}) as bare
        from hits h join (select distinct id, symbol_name, start_line, content from code_chunk where content is not null) c using (id))""",
    "changed_secret_lines": f"""with g as (select task_id, {_PATH.format("new_path")} as path, max_by({{'r': new_ranges, 't': change_type}}, id) as g from git_file_change where new_path is not null group by 1, 2),
      l as (select c.id, c.role in ('SECURITY_CONFIGURATION', 'DATA_ACCESS') as conf, c.start_line + t.i - 1 as line_no, regexp_replace(t.x, '^\\s+|\\s+$', '', 'g') as line, g.g.r as r, g.g.t as t
        from (select id, task_id, p as path2, role, start_line, content from {_roles_of("select *, file_path as path from code_chunk where analysis_scope = 'CHANGED' and content is not null")}) c
        join g on c.task_id = g.task_id and c.path2 = g.path, lateral (select unnest({_LINES.replace("content", "c.content")}) as x, generate_subscripts({_LINES.replace("content", "c.content")}, 1) as i) t),
      k as (select *, regexp_extract(line, '(?i)<(?:password|passwd|pwd|secret|apikey|accesskey|secretkey|privatekey|clientsecret|token|credential)>\\s*([^<]+)\\s*</', 1) as e, regexp_extract(line, '{_ASSIGNED.replace("'", "''")}', 1) as a
        from l where line <> '' and not regexp_matches(line, '^(?:#|//)') and (len(list_filter(r, lambda x: line_no >= x.start and line_no <= x."end")) > 0 or (coalesce(len(r), 0) = 0 and t = 'ADD'))),
      v as (select *, {_CLEAN_SQL.format('e')} as ev, {_CLEAN_SQL.format('a')} as av from k),
      n as (select id, line_no, line, case when regexp_matches(line, '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----') then 'PRIVATE_KEY' when regexp_matches(line, '{_ADDRESS}') then 'ADDRESS'
        when regexp_matches(line, '{_KNOWN}') and not {_STAND_IN_SQL.format('line')} then 'TOKEN' when {_LITERAL_SQL.format('ev', 'true')} then 'ELEMENT' when {_LITERAL_SQL.format('av', 'conf')} then 'ASSIGNMENT' end as kind from v)
      select distinct id, line_no, kind, case when kind = 'ASSIGNMENT' and not regexp_matches(regexp_extract(line, '^([^:=]*)[:=]', 1), '{_KNOWN}') then regexp_extract(line, '^([^:=]*)[:=]', 1) || ': <REDACTED_LITERAL>' else '<REDACTED_' || kind || '>' end as hint from n where kind is not null""",
    "mapper_statements": " union ".join(
        f"""select distinct id, regexp_extract(content, '(?is)<mapper\\s+[^>]*namespace\\s*=\\s*["'']([^"'']+)["'']', 1) as namespace, '{k}' as kind, regexp_extract(s, '(?is)\\bid\\s*=\\s*["'']([^"'']+)["'']', 1) as statement_id, contains(regexp_extract(s, '(?is)^<{k}\\b[^>]*>(.*)</{k}>$', 1), '${{') as spliced
        from (select id, content, unnest(regexp_extract_all(content, '(?is)<{k}\\b[^>]*\\bid\\s*=\\s*["''][^"'']+["''][^>]*>.*?</{k}>')) as s from code_chunk where lower(file_path) like '%.xml' and content like '%<mapper%')"""
        for k in ("select", "insert", "update", "delete")
    ),
    "glob_filter": f"select p as path, count(*) as deliveries from (select {_PATH.format('file_path')} as p from code_chunk) where regexp_matches(p, '^(.*/)?resources/(.*/)?[^/]*\\.xml$') group by p",
    "route_pattern_join": "select endpoint, policy from (select distinct endpoint from code_chunk where endpoint is not null), (values ('^/api/[^/]*/[^/]*/[^/]+/[^/]*$', 'by_id'), ('^/api/[^/]+(?:/.*)?$', 'zone'), ('^/api/[^/]*/[^/]*/[^/]*/export$', 'export'), ('^/admin(?:/.*)?$', 'admin')) t(re, policy) where regexp_matches(endpoint, re)",
    "symbol_names": """select lower(regexp_replace(regexp_replace(symbol_name, '\\(.*', ''), '^.*[#.:]', '')) as simple_name,
      upper(regexp_replace(regexp_replace(regexp_replace(trim(regexp_extract(annotations, '@(\\w+)', 1)), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as annotation,
      regexp_replace(regexp_replace('//v1//' || coalesce(endpoint, ''), '/+', '/', 'g'), '/$', '') as route, count(distinct id) as pieces
      from code_chunk where symbol_name is not null group by 1, 2, 3""",
    "code_similarity": f"""select distinct id, round(case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) as similarity
      from (select id, {_SETS.format("content")} as a, {_SETS.format("base_content")} as b from code_chunk where change_type in ('MODIFIED', 'RENAMED') and chunk_type = 'METHOD')""",
    "guards_diff": f"""select * from (select distinct id, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as guards_added, array_to_string(list_sort(list_filter(b, lambda x: not list_contains(a, x))), ',') as guards_removed
      from (select id, list_filter({_GUARD_LIST}, lambda w: contains(lower(content), w)) as a, list_filter({_GUARD_LIST}, lambda w: contains(lower(base_content), w)) as b
        from code_chunk where base_content is not null and base_content <> '' and content is not null)) where guards_added <> '' or guards_removed <> ''""",
}
