import datetime as dt
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slatewing.operators import folds, graph, intervals, rules, search, snapshot_diff
from slatewing.sources import java, sinks

FEW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
SPANS = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 120), st.integers(0, 90)), max_size=12)


def spans(spark, rows, a, b):
    return spark.createDataFrame([(k, s, s + n) for k, s, n in rows], f"k int, {a} int, {b} int")


@FEW
@given(SPANS, SPANS)
def test_overlap_join(spark, left, right):
    x, y = spans(spark, left, "a", "b"), spans(spark, right, "c", "d")
    got = sorted(map(tuple, intervals.overlap_join(x, y, ["k"], ("a", "b"), ("c", "d"), 16).select("k", "a", "b", "c", "d").collect()))
    want = sorted((k, s, s + n, t, t + m) for k, s, n in left for j, t, m in right if k == j and s <= t + m and s + n >= t)
    assert got == want


@FEW
@given(SPANS, SPANS)
def test_subtract(spark, ranges, covers):
    got = intervals.subtract(spans(spark, ranges, "lo", "hi"), spans(spark, covers, "lo", "hi"), ["k"], "lo", "hi").collect()
    points = [(r.k, n) for r in got for n in range(r.lo, r.hi + 1)]
    want = {(k, n) for k, s, m in ranges for n in range(s, s + m + 1)} - {(k, n) for k, s, m in covers for n in range(s, s + m + 1)}
    assert sorted(points) == sorted(want)


def test_islands_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (1, 7, 8), (1, None, 4), (1, None, 4)], "k int, lo int, hi int")
    assert intervals.islands(df, ["k"], "lo", "hi").select("island").distinct().count() == 4
    assert sorted(map(tuple, intervals.merged(df, ["k"], "lo", "hi").collect())) == [(1, 1, 5), (1, 7, 8)]


def test_context_windows_merge_neighbours(spark):
    hits = spark.createDataFrame([(1, 2, 20), (1, 4, 20), (1, 9, 20)], "id int, line int, last int")
    got = intervals.context_windows(hits, ["id"], "line", 1, "last").orderBy("first_line").collect()
    assert [(r.first_line, r.end_line, r.hits) for r in got] == [(1, 5, 2), (8, 10, 1)]


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)]


def test_reach_and_paths(spark):
    e = spark.createDataFrame(EDGES, "src int, dst int")
    starts = spark.createDataFrame([(1,), (5,)], "start int")
    got = {(r.start, r.node): r.hops for r in graph.reach(e, starts, 6).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (5, 5): 0}
    paths = sorted(tuple(r.path) for r in graph.simple_paths(e, starts, 3).collect())
    assert paths == [(1, 2), (1, 2, 3), (1, 2, 3, 4)]
    assert graph.reach(e.limit(0), starts, 3).count() == 2


def test_fixpoint(spark):
    e = spark.createDataFrame(EDGES, "src int, dst int")
    facts = spark.createDataFrame([(4, "x")], "node int, fact string")
    assert sorted(r.node for r in graph.fixpoint(e, facts).collect()) == [1, 2, 3, 4]


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), max_size=25))
def test_greedy_batches(spark, rows):
    df = spark.createDataFrame([(g, i, n) for i, (g, n) in enumerate(rows)], "g int, i int, n int")
    got = {r.i: r.batch for r in folds.greedy_batches(df, "g", "i", "n", 3, 50).collect()}
    want, state = {}, {}
    for i, (g, n) in enumerate(rows):
        batch, count, total = state.get(g, (1, 0, 0))
        if count and (count + 1 > 3 or total + n > 50):
            batch, count, total = batch + 1, 0, 0
        state[g] = (batch, count + 1, total + n)
        want[i] = batch
    assert got == want


def test_line_windows(spark):
    text = "\n".join(["x" * 9] * 5 + ["y" * 40] + ["z"])
    got = spark.createDataFrame([(text,), (None,)], "t string").select(folds.line_windows(F.col("t"), 3, 30).alias("w")).collect()
    assert [(w.first, w.end) for w in got[0].w] == [(1, 3), (4, 5), (6, 6), (7, 7)]
    assert [(w.first, w.end) for w in got[1].w] == [(1, 1)]


def test_rules(spark):
    rows = [
        (1, "t", "A.java", "A#x", "/api/{id}", 10, "a\nmapper.selectById(id)"),
        (2, "t", "B.java", "B#deleteAll", "/admin/x", 5, "@PreAuthorize(x)"),
        (3, "t", "C.xml", None, None, 1, "where a = ${b}"),
        (4, "t", "D.java", None, None, 1, None),
    ]
    c = spark.createDataFrame(rows, "id long, task_id string, file_path string, symbol_name string, endpoint string, start_line int, content string")
    got = {(r.id, r.rule, r.line) for r in rules.scan(c.unionByName(c)).collect()}
    assert got == {(1, "direct_object_access", 11), (3, "dynamic_sql", 1)}


T0 = dt.datetime(2024, 1, 1)
FINDING = "id string, task_id string, fingerprint string, severity string, confidence string, title string, start_line int, end_line int, endpoint string, description string, remediation string, created_at timestamp, snapshot string"


def finding(task, fp, hour=0, **changes):
    base = {"severity": "HIGH", "confidence": "LOW", "title": "a  b", "start_line": 1, "end_line": 2, "endpoint": None, "description": "d", "remediation": "r"} | changes
    return ("x", task, fp, *base.values(), T0 + dt.timedelta(hours=hour), "clash")


def task(i, day, status="COMPLETED", version=1, project="p"):
    return (i, project, status, T0 + dt.timedelta(days=day), version, "clash")


TASK = "id string, project_id string, status string, created_at timestamp, version long, position string"


def changes(spark, findings, tasks):
    f, t = spark.createDataFrame(findings, FINDING), spark.createDataFrame(tasks, TASK)
    return sorted((r.task_id, r.fingerprint, r.change, tuple(r.changed_columns)) for r in snapshot_diff.finding_changes(f, t).collect())


def test_snapshot_changes(spark):
    tasks = [task("1", 1), task("2", 2), task("bad", 3, "FAILED"), task("3", 4), task("3", 4, "FAILED", 0), task("other", 1, project="q"), task(None, 1), task("nop", 1, project=None)]
    findings = [
        finding("1", " A "), finding("1", "B"), finding("1", None), finding("1", "  "), finding("1", "A"),
        finding("2", "a", title=" A\tb" .replace("A", "a"), severity="high ", endpoint=" "), finding("2", "c"), finding("2", "c", 5, title="new"), finding("bad", "z"), finding("other", "o"), finding("nop", "n"), finding(None, "n"),
    ]
    assert changes(spark, findings, tasks) == [
        ("2", "b", "REMOVED", ()), ("2", "c", "ADDED", ()), ("3", "a", "REMOVED", ()), ("3", "c", "REMOVED", ()),
    ]


def test_snapshot_changed_columns_use_latest(spark):
    findings = [finding("1", "a"), finding("2", "a", 1, start_line=9), finding("2", "a", 2, start_line=None, description=None), finding("1", "A", -1, title="old")]
    assert changes(spark, findings, [task("1", 1), task("2", 2)]) == [("2", "a", "CHANGED", ("start_line", "description"))]


def test_snapshot_empty_tables(spark):
    assert changes(spark, [], []) == []
    assert changes(spark, [finding("1", "a")], []) == []


def test_search_arguments():
    ok = {"query": str, "limit": int, "cursor": int}
    for bad in ({"x": 1}, {"query": 3}, {"query": ""}, {"query": "a", "limit": 21}, {"query": "a", "limit": 0}, {"query": "a", "cursor": -1}, {"query": "a" * 501}):
        with pytest.raises(ValueError):
            search.checked(bad, ok, ("query",))


def test_search_pages_are_disjoint(spark):
    c = spark.createDataFrame([(i, f"a/S{i}.java", "x\nfoo(.*)\ny\nFOO(.*)\nz") for i in range(7)], "id long, file_path string, content string")
    pages = [search.search_code(c, query="foo(.*)", context=0, limit=4, cursor=k).collect() for k in (0, 4, 8, 12, 16)]
    assert [len(p) for p in pages] == [4, 4, 4, 2, 0]
    assert len({(r.id, r.first_line) for p in pages for r in p}) == 14
    one = search.search_code(c, query="foo", context=1, glob="S3.java").collect()
    assert [(r.first_line, r.end_line, r.hits) for r in one] == [(1, 5, 2)]


JAVA = '''package a;
public class Foo<T> {
    private final int[] x = {1, 2};
    /** } */
    @GetMapping("/a{id}")
    public List<String> load(Long id, String s) {
        String t = "}{"; char c = '}';
        if (ok(id)) { mapper.selectById(id); }
        Runnable r = new Runnable() { public void run() { go(); } };
        return s;
    }
    Foo() { super(); }
    @Test void checks() { bar(); }
    abstract int sum(int a);
}
'''


def test_java_methods():
    got = [(m["owner"], m["name"], m["parameters"], m["start_line"], m["end_line"]) for m in java.java_methods(JAVA)]
    assert got == [("Foo", "load", "Long id, String s", 5, 11), ("Foo", "Foo", "", 12, 12), ("Foo", "sum", "int a", 14, 14)]
    assert {"selectById", "ok", "go"} <= set(java.java_methods(JAVA)[0]["calls"])
    assert java.java_methods("") == [] and java.java_methods("} broken {") == []


def test_line_diffs(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nx\ny\nc"), (2, "a", "a"), (3, None, "n"), (4, None, None)], "id long, base_content string, content string")
    got = {r.id: (r.additions, r.deletions, [tuple(x) for x in r.old_ranges], [tuple(x) for x in r.new_ranges]) for r in java.line_diffs(df).collect()}
    assert got == {1: (2, 1, [(2, 2)], [(2, 3)]), 3: (1, 1, [(1, 1)], [(1, 1)])}
    assert java.unified("a\nb", "a\nc").splitlines() == ["@@ -1,2 +1,2 @@", " a", "-b", "+c"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=40), st.lists(st.sampled_from("abcdefg"), max_size=40))
def test_line_edits_lead_from_old_to_new(a, b):
    edits = java.line_edits("\n".join(a), "\n".join(b))
    x, y = "\n".join(a).split("\n"), "\n".join(b).split("\n")
    out, at, to = [], 0, 0
    for i, j, k, n in edits:
        assert at <= i <= j and to <= k <= n and i - at == k - to and x[at:i] == y[to:k] and (i < j or k < n)
        out += x[at:i] + y[k:n]
        at, to = j, n
    assert out + x[at:] == y and x[at:] == y[to:]


def test_line_edits_of_long_texts():
    old = [f"line {i}" for i in range(40_000)] + ["}"] * 500
    new = [x for i, x in enumerate(old) if i >= 40_000 or i % 1000 != 7]
    began = time.perf_counter()
    assert java.line_edits("\n".join(old), "\n".join(new)) == [(i, i + 1, i - k, i - k) for k, i in enumerate(range(7, 40_000, 1000))]
    assert time.perf_counter() - began < 20


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "task string, n int")
    sinks.overwrite_partitions(df, path, ["task"])
    sinks.overwrite_partitions(spark.createDataFrame([("b", 9)], "task string, n int"), path, ["task"])
    assert sorted((r.task, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 9)]
    current = spark.createDataFrame([("x", "OLD", 3), ("y", "OLD", 5)], "id string, status string, version int")
    update = spark.createDataFrame([("x", "NEW", 3), ("y", "NEW", 4)], "id string, status string, version int")
    assert sorted(map(tuple, sinks.with_version(current, update).collect())) == [("x", "NEW", 4), ("y", "OLD", 5)]
    kept = sinks.kept_snapshots(spark.createDataFrame([(c, i) for i, c in enumerate("abcd")], "commit string, used_at int"), 1)
    assert sorted(r.commit for r in kept.collect()) == ["c", "d"]
    assert sinks.html_rows(spark.createDataFrame([("<a&b>",)], "x string"), ["x"]).first().html == "<tr><td>&lt;a&amp;b&gt;</td></tr>"
    report = sinks.json_report({"rows": df, "more": df.where("n = 2")}, "task").orderBy("task").collect()
    assert report[0].report == '{"rows":[{"n":1}]}' and '"more":[{"n":2}]' in report[1].report
