"""Roles of repository files, by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatewing.functions.text import normal_path

#: Folders that are left out, in lower case.
EXCLUDED = (
    ".git", ".github", ".idea", ".vscode", ".gradle", "target", "build", "out", "dist", "coverage", "node_modules",
    "bower_components", "vendor", "third_party", "third-party", "generated", "generated-sources", "generated-test-sources",
    "test", "tests", "__tests__", "testfixtures", "test-fixtures", "testdata", "test-data", "__fixtures__", "androidtest",
    "integrationtest", "integration-test", "docs", "documentation", ".nyc_output", ".pytest_cache", "__pycache__",
)
#: Names of tests, generated assets, build files, and the name and place patterns of the other roles.
TEST_TYPES = r"(?:^Test[A-Z].*|Test|Tests|TestCase|IntegrationTest|IT)\.java$"
TEST_NAMES = r"\.test\.|\.spec\.|^application-test\.|^application-integrationtest\."
GENERATED = r"\.(?:min\.js|bundle\.js|min\.jsx|min\.ts)$"
BUILD = r"^(?:pom\.xml|build\.gradle|build\.gradle\.kts|settings\.gradle|settings\.gradle\.kts)$"
CONFIGURATION = r"^\.env$|^\.env\.|\.(?:properties|yml|yaml)$"
DATA_XML_NAMES, DATA_XML_PLACES = r"mapper\.xml$|mybatis.*\.xml$", r"(?:/mapper/|/mappers/|/db/changelog/).*\.xml$"
SECURITY_XML_NAMES, SECURITY_XML_PLACES = (
    r"^web\.xml$|^(?:applicationcontext|spring-|logback|log4j).*\.xml$|security.*\.xml$",
    r"(?:/meta-inf/|/web-inf/).*\.xml$",
)
TEMPLATES, TEMPLATE_PLACES = r"\.(?:jsp|ftl)$", r"(?:^|/)(?:templates|webapp|web-inf)/.*\.html?$"
FRAMEWORK = r"^(?:application|bootstrap)(?:-[^.]+)?\.(?:yml|yaml|properties)$"


def file_role(path: Column) -> Column:
    """One of six roles; the first rule that fits decides. Null and blank paths are IGNOREd."""
    p = normal_path(path)
    name = F.regexp_extract(p, r"[^/]*$", 0)
    low, whole = F.lower(name), F.lower(p)
    excluded = F.arrays_overlap(F.split(whole, "/"), F.array(*[F.lit(x) for x in EXCLUDED]))
    java = low.endswith(".java")
    test = F.when(name.endswith(".java"), name.rlike(TEST_TYPES)).otherwise(low.rlike(TEST_NAMES))
    return (
        F.when((p == "") | excluded | test | low.rlike(GENERATED), "IGNORE")
        .when(low.rlike(BUILD), "BUILD_METADATA")
        .when(java, "JAVA_SOURCE")
        .when(low.rlike(CONFIGURATION), "SECURITY_CONFIGURATION")
        .when(low.endswith(".sql") | low.rlike(DATA_XML_NAMES) | whole.rlike(DATA_XML_PLACES), "DATA_ACCESS")
        .when(low.rlike(SECURITY_XML_NAMES) | whole.rlike(SECURITY_XML_PLACES), "SECURITY_CONFIGURATION")
        .when(low.rlike(TEMPLATES) | whole.rlike(TEMPLATE_PLACES), "SERVER_TEMPLATE")
        .otherwise("IGNORE")
    )


def framework_context(path: Column) -> Column:
    """Build files, and the main configuration files of the application."""
    role = file_role(path)
    name = F.lower(F.regexp_extract(normal_path(path), r"[^/]*$", 0))
    return (role == "BUILD_METADATA") | ((role == "SECURITY_CONFIGURATION") & name.rlike(FRAMEWORK))
