"""Rule scanners over code pieces: one registry of predicates, one pass over the table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewing.functions.text import contains_any, first_match_line, matches

#: The scanners' patterns and word lists.
DYNAMIC_SQL = r"\$\{|(?:select|update|delete|insert)\s+[^\n;]*(?:\+|concat\s*\()|create(?:native)?query\s*\([^\n;]*\+|statement\s*\.\s*execute"
RAW_HTML = r"v-html|dangerouslySetInnerHTML|th:utext|innerHTML\s*=|<%=|\|\s*safe"
BYPASS = r"skipverify|bypassverify|ignoreverification|verify\w*\s*\([^;]+;\s*(?!if)|catch\s*\([^)]*\)\s*\{[^}]{0,300}(?:warn|ignore|continue)"
BY_ID = r"(?:get|select|find|delete|update)ById\s*\("
STORES = r"\.(?:save|insert|updateById)\s*\("
SENSITIVE_FIELD = r"password|secret|apiKey|privateKey|idCard|bankCard|balance|token|salary"
RESOURCE_IDS = ["{id}", "orderid", "userid", "accountid", "resourceid"]
LOOKUPS = ["getbyid(", "selectbyid(", "findbyid(", "deletebyid(", "updatebyid("]
OWNERSHIP = ["currentuserid", "loginuserid", "ownerid", "tenantid", "createdby", "datascope", "checkowner"]
SENSITIVE_ACTIONS = ["admin", "permission", "role", "refund", "withdraw", "export", "delete", "disable", "approve"]
GUARDS = ["@preauthorize", "@secured", "@rolesallowed", "checkpermission", "hasrole", "hasauthority", "checkrole"]
PUBLIC_CODE, PUBLIC_ROUTES = ["permitall", "@anonymous", "@permitall"], ["/public/", "/open/", "/anonymous/"]
SENSITIVE_DATA = ["password", "secret", "apikey", "privatekey", "idcard", "bankcard", "balance", "token", "salary"]
PERSISTS, FREE_TEXT = [".save(", "insert(", "updatebyid("], ["content", "comment", "description", "notice", "nickname"]
CLEANERS = ["sanitize", "encodeforhtml", "htmlclean", "jsoup.clean"]
VERIFIES = ["verify", "captcha", "otp", "signature", "checkpassword", "approve", "validatestatus"]


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    severity: str
    confidence: str
    applies: Callable[[], Column]
    line: Callable[[], Column]


def _line(pattern: str) -> Callable[[], Column]:
    return lambda: first_match_line(F.col("content"), pattern, F.col("start_line"))


def _direct_access() -> Column:
    both = F.concat(F.col("endpoint"), F.coalesce("content", F.lit("")))
    return F.col("endpoint").isNotNull() & contains_any(both, RESOURCE_IDS) & contains_any(F.col("content"), LOOKUPS) & ~contains_any(F.col("content"), OWNERSHIP)


def _missing_role() -> Column:
    named = F.concat_ws(" ", "endpoint", F.coalesce("symbol_name", F.lit("null")))
    return F.col("endpoint").isNotNull() & contains_any(named, SENSITIVE_ACTIONS) & ~contains_any(F.col("content"), GUARDS)


def _public_data() -> Column:
    public = contains_any(F.col("content"), PUBLIC_CODE) | contains_any(F.col("endpoint"), PUBLIC_ROUTES)
    return F.col("endpoint").isNotNull() & public & contains_any(F.col("content"), SENSITIVE_DATA)


def _stored_text() -> Column:
    c = F.col("content")
    return ~matches(c, RAW_HTML) & contains_any(c, PERSISTS) & contains_any(c, FREE_TEXT) & ~contains_any(c, CLEANERS)


RULES = [
    Rule("dynamic_sql", "SQL_INJECTION", "CRITICAL", "HIGH", lambda: matches(F.col("content"), DYNAMIC_SQL), _line(DYNAMIC_SQL)),
    Rule("direct_object_access", "AUTHORIZATION", "HIGH", "MEDIUM", _direct_access, _line(BY_ID)),
    Rule("missing_role", "AUTHORIZATION", "HIGH", "MEDIUM", _missing_role, lambda: F.col("start_line")),
    Rule("public_sensitive", "SENSITIVE_INFORMATION_DISCLOSURE", "HIGH", "MEDIUM", _public_data, _line(SENSITIVE_FIELD)),
    Rule("raw_html", "STORED_XSS", "HIGH", "MEDIUM", lambda: matches(F.col("content"), RAW_HTML), _line(RAW_HTML)),
    Rule("stored_text", "STORED_XSS", "MEDIUM", "LOW", _stored_text, _line(STORES)),
    Rule(
        "validation_bypass", "VALIDATION_BYPASS", "HIGH", "MEDIUM",
        lambda: contains_any(F.col("content"), VERIFIES) & matches(F.col("content"), BYPASS), _line(BYPASS),
    ),
]


def scan(chunks: DataFrame, rules: list[Rule] = RULES, keep: tuple[str, ...] = ("id", "task_id", "file_path")) -> DataFrame:
    """``keep`` columns plus ``rule, type, severity, confidence, line`` for each rule that a row meets.

    One pass: the rules' results are an array that is exploded. Null contents meet no rule that needs
    one; a row delivered twice gives its results once.
    """
    found = F.array(*[
        F.when(r.applies(), F.struct(F.lit(r.name).alias("rule"), F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), r.line().cast("int").alias("line")))
        for r in rules
    ])
    return (
        chunks.select(*keep, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("hit"))
        .select(*keep, "hit.*")
        .distinct()
    )
