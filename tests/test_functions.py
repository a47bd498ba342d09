import pytest
from pyspark.sql import functions as F

from slatewing.functions import text as T
from slatewing.sources.roles import file_role, framework_context


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).cast("string").alias(k) if v is None else F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


ROLES = {
    "IGNORE": [
        "src/test/java/a/FooTest.java", "tests/a.spec.js", "x/__tests__/a.js", "target/generated-sources/A.java", "node_modules/a/index.js", "vendor/A.java",
        ".github/workflows/a.yml", "docs/a.yml", "static/app.bundle.js", "README.md", "src/main.ts", "data/list.xml", "package.json", "", None, "src/FooIT.java", "src/TestFoo.java",
    ],
    "JAVA_SOURCE": ["src/main/java/OrderService.java", "a/Contest.java", "a\\b\\Audit.java", ".//a//Latest.java"],
    "SECURITY_CONFIGURATION": ["src/application.yml", "application-prod.properties", "custom-security.yaml", ".env.production", "conf/spring-beans.xml", "x/WEB-INF/web.xml"],
    "DATA_ACCESS": ["mapper/OrderMapper.xml", "src/mappers/query.xml", "db/migration/V1__schema.sql"],
    "BUILD_METADATA": ["pom.xml", "a/build.gradle.kts", "settings.gradle"],
    "SERVER_TEMPLATE": ["templates/order.html", "a/templates/b/order.htm", "WEB-INF/views/order.jsp", "mail.ftl"],
}


def test_file_roles(spark):
    rows = [(p, r) for r, ps in ROLES.items() for p in ps]
    df = spark.createDataFrame(rows, "path string, role string")
    wrong = df.where(file_role(F.col("path")) != F.col("role")).collect()
    assert wrong == []


def test_framework_context(spark):
    df = spark.createDataFrame([("pom.xml", True), ("a/application-x.yml", True), ("bootstrap.properties", True), ("other.yml", False), ("A.java", False)], "p string, e boolean")
    assert df.where(framework_context(F.col("p")) != F.col("e")).count() == 0


def test_paths_names_and_routes(spark):
    assert one(spark, T.normal_path(F.col("p")), p=" .\\a\\\\b//c ") == "a/b/c"
    assert one(spark, T.normal_path(F.col("p")), p=None) == ""
    assert one(spark, T.simple_name(F.col("p")), p="a.b.C#doIt(Long)") == "doit"
    assert one(spark, T.joined_endpoint(F.col("a"), F.col("b")), a="/x/", b="//y/") == "/x/y"
    assert one(spark, T.enum_name(F.col("p")), p=" sqlInjection-high ") == "SQL_INJECTION_HIGH"


def test_first_match_line_falls_back_over_line_ends(spark):
    at = lambda p, c: one(spark, T.first_match_line(F.col("c"), p, F.lit(10)), c=c)
    assert at("b", "a\nb") == 11
    assert at("a.b", "a\nb") == 10
    assert at("zzz", "a\nb") == 10
    assert one(spark, T.matches(F.col("c"), "a.b"), c="A\nb")


def test_excerpt_and_blanks(spark):
    assert one(spark, T.excerpt(F.col("c"), F.lit(5), F.lit(7), 1), c="a\nb\nc\nd") == "6 | b\n7 | c\n8 | d"
    assert one(spark, T.without_blanks(F.col("c")), c=' a = "x \\" y" + \'p q\' ; ') == 'a="x \\" y"+\'p q\';'


def test_head_tail(spark):
    long = "x" * 500 + "y" * 500
    cut = one(spark, T.head_tail(F.col("c"), 100), c=long)
    assert len(cut) == 100 and cut.startswith("xxx") and cut.endswith("yyy")
    assert one(spark, T.head_tail(F.col("c"), 100), c="short") == "short"


@pytest.mark.parametrize("glob,path,fits", [("**/a/*.xml", "x/y/a/b.xml", True), ("**/a/*.xml", "a/b.xml", True), ("**/a/*.xml", "a/c/b.xml", False), ("a?.j*", "ab.java", True), ("a+.x", "aa.x", False)])
def test_globs(spark, glob, path, fits):
    assert one(spark, F.col("p").rlike(T.glob_pattern(glob)), p=path) is fits


@pytest.mark.parametrize("pattern,route,fits", [("/a/{id}/b", "/a/7/b", True), ("/a/{id}/b", "/a/7/8/b", False), ("/a/**", "/a", True), ("/a/**", "/a/b/c", True), ("/a/*", "/a/b.c", True), ("/a.b", "/axb", False)])
def test_routes(spark, pattern, route, fits):
    df = spark.createDataFrame([(pattern, route)], "p string, r string").withColumn("re", T.route_pattern(F.col("p")))
    assert df.where("r rlike re").count() == int(fits)


def test_jaccard_of_empty_sets(spark):
    assert one(spark, T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b"))), a="", b=None) == 1.0
    assert one(spark, T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b"))), a="a b", b="b c") == pytest.approx(1 / 3)
