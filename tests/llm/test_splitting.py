import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slatewing.llm import splitting as S
from slatewing.llm.units import line_starts, unit_lines

JAVA = """package a;
// head

public class Foo {
    private int[] x = {1, 2};

    /** one } */
    @A("}")
    public void one() { String s = "{"; char c = '{'; }
    // far

    int two(int a)
    {
        Runnable r = new Runnable() { public void run() { } };
        String t = \"\"\"
            public void no() {
            \"\"\";
    }
    @X(
      y = 1)
    static class Inner { void deep() {} }
    Foo() {}
    abstract int three();
    Supplier<X> f = () -> { return g(); };
}
"""


def test_java_units():
    assert [n + 1 for n in unit_lines("A.java", "CLASS", JAVA)] == [7, 12, 19, 22, 23]
    assert unit_lines("A.java", "METHOD", JAVA) == [] and unit_lines("a.js", "TEXT", JAVA) == [] and unit_lines(None, None, JAVA) == []


def test_sql_units():
    sql = "-- head\nCREATE TABLE a (\n  b int\n);\n\n/* x */\nUPDATE a SET b = 'a;b -- c'\n\n WHERE c;\nDROP TABLE a; SELECT 1\n"
    assert [n + 1 for n in unit_lines("a.sql", "SQL", sql)] == [1, 6, 10]


def test_xml_units():
    xml = '<?xml version="1.0"?>\n<m a="x > y">\n  <!-- c -->\n  <s id="1">\n    <![CDATA[ <q> ]]>\n    <if/>\n  </s>\n  <t/>\n\n  <!-- far -->\n\n  <u>\n  </u>\n</m>'
    assert [n + 1 for n in unit_lines("a.xml", "XML", xml)] == [3, 8, 12]


def test_yaml_units():
    yml = "# c\na-0:\n  b: 1\n  t: |\n    x: y\n\n# far\n\n'q x': 2\n- item\n---\nz: {\n  k: 1 }\n"
    assert [n + 1 for n in unit_lines("a.yaml", "CONFIG", yml)] == [1, 9, 12]


def test_lines():
    assert line_starts("") == [0] and line_starts("a\r\nb\n") == [0, 3] and line_starts("\n") == [0]


LINE = st.one_of(st.just(""), st.text("ab ", max_size=30), st.integers(100, 400).map(lambda n: "x" * n), st.integers(1200, 2500).map(lambda n: "y" * n))


@settings(max_examples=120, deadline=None)
@given(st.lists(LINE, max_size=120), st.sampled_from(["\n", "\r\n"]), st.booleans(), st.integers(0, 9))
def test_pieces(rows, end, closed, seed):
    text = end.join(rows) + (end if closed else "")
    n = len(line_starts(text))
    units = sorted(random.Random(seed).sample(range(n), n // 5))
    pieces = S.split_text(text, units, 1000, 40, 4, 50)
    assert "".join(text[p.begin + p.repeated : p.stop] for p in pieces) == text
    for p in pieces:
        part = text[p.begin : p.stop]
        assert len(part) <= 1000 and len(line_starts(part)) <= 40
        assert p.start == text.count("\n", 0, p.begin) and p.end == text.count("\n", 0, max(p.begin, p.stop - 1))


ROW = st.one_of(st.integers(0, 80), st.integers(0, 2500), st.integers(4000, 12_000), st.integers(12_001, 30_000)).map(lambda n: "z" * n)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60).map(lambda n: "z" * n), ROW), max_size=250), st.booleans(), st.integers(0, 9))
def test_pieces_with_real_limits(rows, closed, seed):
    """Both limits hold, the parts concatenate, and each cut repeats the last 8 lines or the most that fit."""
    text = "\n".join(rows) + ("\n" if closed else "")
    starts = line_starts(text)
    units = sorted(random.Random(seed).sample(range(len(starts)), len(starts) // 7))
    pieces = S.split_text(text, units)
    assert "".join(text[p.begin + p.repeated : p.stop] for p in pieces) == text
    offsets = [*starts, len(text)]
    longs = [i for i in range(len(starts)) if offsets[i + 1] - offsets[i] > S.MAX_CHARS]
    for p in pieces:
        part = text[p.begin : p.stop]
        assert len(part) <= S.MAX_CHARS and len(line_starts(part)) <= S.MAX_LINES
    for before, p in zip(pieces, pieces[1:]):
        own = p.begin + p.repeated
        assert before.begin <= p.begin and own == before.stop
        if p.end in longs or own - 1 > 0 and any(offsets[i + 1] == own for i in longs):
            assert p.repeated
            continue
        line = starts.index(own)
        low = max([0, before.start, *(i + 1 for i in longs if i < line)])
        fits = [k for k in range(min(8, line - low) + 1) if p.stop - offsets[line - k] <= S.MAX_CHARS and p.end - (line - k) + 1 <= S.MAX_LINES]
        assert p.begin == offsets[line - max(fits)]


@pytest.mark.parametrize("before", [0, 3, 200, 990, 1500])
def test_any_long_line_is_cut_within_the_limit(before):
    for size in [*range(1001, 4000, 7), 1902, 1950, 1951, 2850, 2851]:
        text = "x" * before + "\n" + "y" * size
        pieces = S.split_text(text, [], 1000, 40, 4, 50)
        assert "".join(text[p.begin + p.repeated : p.stop] for p in pieces) == text and max(p.stop - p.begin for p in pieces) <= 1000


def test_two_long_neighbours_shorten_one_overlap():
    rows = ["x = 1;"] * 250 + ["y" * 5900, "z" * 7000] + ["x = 2;"] * 248
    text = "\n".join(rows)
    pieces = S.split_text(text, [])
    short = [text.count("\n", p.begin, p.begin + p.repeated) for p in pieces[1:]]
    assert len(pieces) <= 6 and sum(k < 8 for k in short) == 1


def test_repeats_eight_lines_of_a_thousand():
    pieces = S.split_text("\n".join(["y" * 1000] * 30), [])
    assert {p.repeated for p in pieces[1:]} == {8 * 1001}


def test_overlap_and_boundaries():
    text = "".join(f"u{i}\n" + "  body\n" * 9 for i in range(40))
    units = list(range(0, 400, 10))
    pieces = S.split_text(text, units)
    assert len(pieces) > 2
    for a, b in zip(pieces, pieces[1:]):
        assert text[b.begin : b.begin + b.repeated] == text[a.begin : a.stop][-b.repeated :] and text.count("\n", b.begin, b.begin + b.repeated) == 8
        assert text.count("\n", 0, b.begin + b.repeated) in units


def test_long_line_repeats_characters():
    text = "z" * 30_000
    pieces = S.split_text(text, [])
    assert [p.repeated for p in pieces] == [0, 200, 200]


def test_rows(spark):
    big = "".join(f"k{i}:\n  a: 1\n" for i in range(90))
    schema = "id long, task_id string, file_path string, chunk_type string, start_line int, content string, line_no int"
    rows = [(1, "t", "a.yml", "CONFIG", 11, big, 5), (1, "t", "a.yml", "CONFIG", 11, big, 5), (2, "t", "a.yml", "CONFIG", 1, "a: 1", 5), (3, None, None, None, None, "x\n" * 161, None), (4, None, None, None, None, None, None), (None, None, None, None, None, big, None)]
    df = spark.createDataFrame(rows, schema)
    got = S.unit_starts(df).collect()
    assert {(r.id, r.line_no) for r in got} == {(1, 2 * i + 1) for i in range(90)} | {(3, 1)} and len(got) == 91
    pieces = S.split_chunks(df).where("id = 1").dropDuplicates(["piece_no"]).orderBy("piece_no").collect()
    assert pieces[0].start_line == 11 and pieces[-1].end_line == 190
    assert S.unit_starts(df.limit(0)).count() == 0


@pytest.mark.parametrize("n,over", [(160, False), (161, True)])
def test_limits(n, over):
    assert S.oversized("x\n" * n) is over
