"""Queries on planted tables, where the SQL beside them sees less than the whole."""

from slatewing.plans import change_intervals, graphs


def test_hunks_of_added_and_deleted_files(spark, tmp_path):
    span = "array<struct<start:int,end:int>>"
    rows = [
        ("both", [(1, 2), (4, 5), (40, 41)], [(1, 3), (5, 6), (41, 42)]),
        ("added", [], [(1, 10), (12, 20), (50, 60)]), ("added_null", None, [(1, 4)]),
        ("deleted", [(1, 10), (30, 40)], []), ("deleted_null", [(7, 8)], None), ("none", [], []),
    ]
    spark.createDataFrame(rows, f"id string, old_ranges {span}, new_ranges {span}").write.parquet(f"{tmp_path}/git_file_change.parquet")
    got = sorted(map(tuple, change_intervals.hunk_groups(spark, str(tmp_path)).select("id", "hunk", "edits", "first_line", "end_line").collect()))
    assert got == [
        ("added", 1, 2, 1, 20), ("added", 2, 1, 50, 60), ("added_null", 1, 1, 1, 4), ("both", 1, 2, 1, 6), ("both", 2, 1, 41, 42),
        ("deleted", 1, 1, None, None), ("deleted", 2, 1, None, None), ("deleted_null", 1, 1, None, None),
    ]


SCHEMA = (
    "id long, task_id string, file_path string, symbol_name string, endpoint string, start_line int, end_line int, content string, chunk_type string, "
    "parameters string, annotations string, called_symbols array<string>, change_type string, analysis_scope string, base_content string"
)


def _methods(spark, folder, rows):
    """Rows ``(id, symbol, endpoint, parameters, content, called)`` as the pieces of one task."""
    made = [(i, "t", "A.java", s, e, 1, 9, c, "METHOD", p, "", called, "MODIFIED", "CHANGED", None) for i, s, e, p, c, called in rows]
    spark.createDataFrame([*made, *made[:1]], SCHEMA).write.mode("overwrite").parquet(f"{folder}/code_chunk.parquet")
    return str(folder)


CHAIN = [
    (1, "OrderItemController#findOrderItem(Long)", "/orders/{id}", "Long id", "orderItemService.load(id);", ["load"]),
    (3, "OrderItemService#loadOrderItem(Long)", None, "Long id", "return mapper.resolve(id);", ["resolve"]),
    (4, "OrderItemMapper#resolveOrderItem(Long)", None, "Long id", 'mapper.selectById(id); jdbc("select a from b where id = " + id)', []),
    (9, "OtherThingService#loadOther(Long)", None, "Long id", "", ["resolve"]),
]


def test_graph_has_all_edges(spark, tmp_path):
    """Every target of a call is an edge, whatever their number; LOW ones take no part in searches."""
    many = [(10 + i, f"OrderItemController#loadOrderItem{i}()", None, "", "", []) for i in range(6)]
    at = _methods(spark, tmp_path, CHAIN + many)
    got = {(r.src, r.dst, r.confidence) for r in graphs.call_edges(spark, at).collect()}
    assert got == {(3, 4, "HIGH"), (1, 3, "LOW"), *((1, 10 + i, "MEDIUM") for i in range(6))}
    assert {(r.start, r.node) for r in graphs.graph_hops(spark, at).collect()} == {(3, 4), *((1, 10 + i) for i in range(6))}
    assert [(r.calls, r.resolved, r.high, r.medium, r.low) for r in graphs.call_coverage(spark, at).collect()] == [(3, 2, 1, 6, 1)]


def test_best_path_is_chosen_from_all_flows(spark, tmp_path):
    """The flow that covers most calls counts, chosen from all states that show the risk."""
    at = _methods(spark, tmp_path, CHAIN)
    flows = {(r.start, r.risk, r.path, r.confidence) for r in graphs.taint_paths(spark, at).collect()}
    assert flows == {(1, "SQL_INJECTION", "1>3>4", "HIGH"), (1, "AUTHORIZATION_OWNER", "1>3>4", "HIGH")}
    deeper = CHAIN[:2] + [(4, *CHAIN[2][1:5], ["find"]), (5, "OrderItemMapper#findOrderItemRows(Long)", None, "Long id", CHAIN[2][4], [])]
    at = _methods(spark, tmp_path, deeper)
    # the controller's method begins with the called name as well, but lies on the path already
    best = {(r.start, r.risk): r.path for r in graphs.best_path_per_key(spark, at).collect()}
    assert best == {(1, "SQL_INJECTION"): "1>3>4>5", (1, "AUTHORIZATION_OWNER"): "1>3>4>5"}


def test_guards_on_the_path_suppress_flows(spark, tmp_path):
    owned = [CHAIN[0], (*CHAIN[1][:4], "checkOwner(id); return mapper.resolve(id);", ["resolve"]), CHAIN[2]]
    assert {r.risk for r in graphs.taint_paths(spark, _methods(spark, tmp_path, owned)).collect()} == {"SQL_INJECTION"}
    refund = (4, "OrderItemMapper#resolveOrderItem(Long)", None, "Long id", "mapper.selectById(id); refundGateway.refund(id);", [])
    both = {r.risk for r in graphs.taint_paths(spark, _methods(spark, tmp_path, [*CHAIN[:2], refund])).collect()}
    assert both == {"AUTHORIZATION_OWNER", "AUTHORIZATION_ROLE"}
    guarded = [(*CHAIN[0][:4], "checkRole(x); orderItemService.load(id);", ["load"]), CHAIN[1], refund]
    assert {r.risk for r in graphs.taint_paths(spark, _methods(spark, tmp_path, guarded)).collect()} == {"AUTHORIZATION_OWNER"}


def test_a_search_ends_after_its_states(spark):
    from slatewing.operators import graph as G

    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a != b], "src int, dst int")
    got = G.simple_paths(edges, spark.createDataFrame([(0,), (1,)], "start int"), 4, states=20, own=True)
    per = {(r.start, r.hops): r.n for r in got.groupBy("start", "hops").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert per == {(s, h): n for s in (0, 1) for h, n in ((0, 1), (1, 5), (2, 14))}


SECRET = "Kes0Island41xyz"
LINES = [
    # configuration, line, kind, hint
    (False, f'String password = "{SECRET}";', "ASSIGNMENT", "String password : <REDACTED_LITERAL>"), (True, f"db.password: {SECRET}", "ASSIGNMENT", "db.password: <REDACTED_LITERAL>"), (False, f"password = {SECRET};", None, None),
    (False, "-----BEGIN RSA PRIVATE KEY-----", "PRIVATE_KEY", "<REDACTED_PRIVATE_KEY>"), (True, f"url: redis://svc:{SECRET}@host/0", "ADDRESS", "<REDACTED_ADDRESS>"),
    (False, "call(ghp_" + "a1B2" * 6 + ");", "TOKEN", "<REDACTED_TOKEN>"), (False, 'x(AKIA' + "A1" * 8 + ', apiKey = "' + SECRET + '")', "TOKEN", "<REDACTED_TOKEN>"), (True, f"<clientSecret>{SECRET}</clientSecret>", "ELEMENT", "<REDACTED_ELEMENT>"),
    (True, "<clientSecret>${CLIENT}</clientSecret>", None, None), (True, "password: ${DB_PASSWORD}", None, None), (True, f"password: ${{DB_PASSWORD:{SECRET}}}", "ASSIGNMENT", "password: <REDACTED_LITERAL>"),
    (True, "api-key: your-key", None, None), (True, "token: ENC(abc)", None, None), (True, "secret: null", None, None), (False, 'String secret = System.getenv("A");', None, None), (True, "secret: sample", None, None), (True, "access-key:", None, None),
]


def test_no_hint_holds_a_secret(spark):
    from pyspark.sql import functions as F

    from slatewing.plans.code_rules import secret_hint, secret_kind

    df = spark.createDataFrame([(c, x) for c, x, *_ in LINES], "configuration boolean, line string")
    df = df.withColumn("kind", secret_kind(F.col("line"), F.col("configuration"))).withColumn("hint", secret_hint(F.col("line"), F.col("kind")))
    got = [(r.configuration, r.line, r.kind, r.hint) for r in df.collect()]
    assert [(c, x, k, " ".join(h.split()).replace(" :", ":") if h else None) for c, x, k, h in got] == [(c, x, k, h.replace(" :", ":") if h else None) for c, x, k, h in LINES]
    assert not any(h and (SECRET in h or "ghp_" in h or "AKIA" in h) for *_, h in got)
