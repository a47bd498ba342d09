"""Queries on methods, on planted tables."""

from slatewing.plans import methods

CHUNK = (
    "id long, task_id string, file_path string, symbol_name string, endpoint string, start_line int, end_line int, content string, chunk_type string, "
    "parameters string, annotations string, called_symbols array<string>, change_type string, analysis_scope string, base_content string"
)
FINDING = (
    "id string, task_id string, type string, severity string, confidence string, title string, file_path string, start_line int, end_line int, "
    "endpoint string, created_at timestamp"
)


def _chunk(i, task, symbol, content="", path="src/A.java", lines=(1, 9), endpoint=None, kind="METHOD"):
    return (i, task, path, symbol, endpoint, *lines, content, kind, None, None, [], "MODIFIED", "CHANGED", None)


def _write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_six_kinds_of_changes(spark, tmp_path):
    old = [
        _chunk(1, "t1", "A#find(Long)", "x find(Long i) { checkRole(i); a(); }"), _chunk(2, "t1", "A#update(Long)", "x update(Long i) { b(); }"), _chunk(3, "t1", "A#removeLegacy()", "x removeLegacy() { c(); }"),
        _chunk(4, "t1", "A#same()", "x same() { d(); }"), _chunk(5, "t1", "A#twice()", "x twice() { e(); }", "src/B.java"), _chunk(6, "t1", "B#gone()", "x gone() { }", "src/Unchanged.java"),
    ]
    new = [
        _chunk(11, "t2", "A#find(Long)", "x find(Long i) { a(); }"), _chunk(12, "t2", "A#update(Long,String)", "x update(Long i, String s) { b(); }"), _chunk(13, "t2", "A#created()", "@Secured x created() { f(); }"),
        _chunk(14, "t2", "A#same()", "x same() {\n  d();\n}", ".//src\\A.java"), _chunk(15, "t2", "A#twice()", "x twice() { @Secured e(); }"), _chunk(16, "t2", "A#twice()", "x twice() { e(); }", "src/B.java"),
    ]
    tasks = [("t1", "p", "2024-01-01", 1), ("t2", "p", "2024-01-02", 1), ("t3", "q", "2024-01-03", 1)]
    changes = [("t2", "src/A.java", "src/A.java"), ("t2", "src/B.java", None)]
    at = _write(
        spark, tmp_path, code_chunk=([*old, *new, new[0], _chunk(None, "t2", "A#x()"), _chunk(20, None, "A#y()"), _chunk(21, "t2", None)], CHUNK),
        audit_task=(tasks, "id string, project_id string, created_at string, version long"), git_file_change=(changes, "task_id string, old_path string, new_path string"),
    )
    got = {tuple(r) for r in methods.method_changes(spark, at).select("kind", "base_id", "target_id").collect()}
    assert got == {
        ("METHOD_MODIFIED", 1, 11), ("GUARD_REMOVED", 1, 11), ("SIGNATURE_CHANGED", 2, 12), ("METHOD_DELETED", 3, None), ("METHOD_ADDED", None, 13), ("METHOD_ADDED", None, 15),
    }
    order = [(r.place, r.kind) for r in methods.change_order(spark, at).orderBy("place").collect()]
    assert [p for p, _ in order] == [1, 2, 3, 4, 5, 6]


def test_locations(spark, tmp_path):
    pieces = [
        _chunk(1, "t", "S#load()", path="src/S.java", lines=(10, 20)), _chunk(2, "t", "S#save()", path="src/S.java", lines=(24, 35), endpoint="/save"), _chunk(3, "t", "O#a()", path="mod/src/O.java", lines=(1, 9)),
        _chunk(4, "t", "V#a()", path="src/V.java", lines=(1, 9)), _chunk(5, "t", "V#a(Long)", path="src/V.java", lines=(5, 15)),
    ]

    def finding(i, path, start, end=None, endpoint=None, kind="X"):
        return (i, "t", kind, "HIGH", "HIGH", "t", path, start, end if end else start, endpoint, None)

    rows = [
        finding("a", "src\\S.java", 27), finding("b", "src/Missing.java", 3), finding("c", "src/S.java", None), finding("d", "/build/x/mod/src/O.java", 4), finding("e", "src/S.java", 99, endpoint=" /save "),
        finding("f", "src/V.java", 7), finding("g", "src/V.java", 12), finding("h", "O.java", 50), finding("i", None, 1),
    ]
    at = _write(spark, tmp_path, code_chunk=(pieces, CHUNK), finding=([*rows, rows[0]], FINDING))
    got = {r.id: (r.piece_id, r.how) for r in methods.locate_unique(spark, at).collect()}
    assert got == {
        "a": (2, "LINE"), "b": (None, "NONE"), "c": (None, "NONE"), "d": (3, "LINE"), "e": (2, "ENDPOINT"), "f": (None, "NONE"), "g": (5, "LINE"), "h": (3, "ONLY"), "i": (None, "NONE"),
    }
    assert {r.piece_id for r in methods.locate_loose(spark, at).collect()} == {2, 4, 5}


def test_candidates_merge_by_type_and_piece(spark, tmp_path):
    pieces = [_chunk(101, "t", "S#load()", path="src/S.java", lines=(50, 90))]
    spans = [("a", "X", 61, 62), ("b", "X", 62, 63), ("c", "X", 70, 70), ("d", "Y", 61, 62), ("e", "X", None, None)]
    rows = [(i, "t", k, "HIGH", "HIGH", "t", "src/S.java", s, e, None, None) for i, k, s, e in spans]
    at = _write(spark, tmp_path, code_chunk=(pieces, CHUNK), finding=(rows, FINDING))
    got = {(r.type, r.start_line, r.end_line, r.ids) for r in methods.merge_candidates(spark, at).collect()}
    assert got == {("X", 61, 63, "a,b"), ("X", 70, 70, "c"), ("Y", 61, 62, "d"), ("X", None, None, "e")}


def test_findings_merge_by_symbol(spark, tmp_path):
    pieces = [_chunk(1, "t", "S#a()", path="src/S.java", lines=(1, 10)), _chunk(2, "t", "S#b()", path="src/S.java", lines=(11, 30))]
    spans = [("a", 8, 12), ("b", 9, 11), ("c", 11, 14), ("d", 13, 16), ("e", 40, 41), ("f", 41, 45), ("g", None, 3), ("h", 31, 40)]
    rows = [(i, "t", "X", "low" if i != "d" else " CRITICAL", "HIGH", "t", "src/S.java", s, e, None, None) for i, s, e in spans]
    at = _write(spark, tmp_path, code_chunk=(pieces, CHUNK), finding=([*rows, rows[1], (*rows[0][:2], "Y", *rows[0][3:])], FINDING))
    got = {(r.type, r.start_line, r.end_line, r.symbol, r.ids, r.severity_rank) for r in methods.merge_findings(spark, at).collect()}
    # a and b lie in S#a(), c and d in S#b(): they overlap, but stay apart; e, f and h have no symbol
    assert got == {
        ("X", 8, 12, "S#a()", "a,b", 3), ("X", 11, 16, "S#b()", "c,d", 0), ("X", 31, 45, "", "e,f,h", 3), ("X", None, 3, "", "g", 3), ("Y", 8, 12, "S#a()", "a", 3),
    }
