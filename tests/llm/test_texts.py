"""Truncation, packing, leakage: against brute force and planted cases."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from slatewing.llm import leakage as L
from slatewing.llm import packing as P
from slatewing.llm import truncation as T

NAMES = ["Order", "Invoice", "Shipment", "Parcel", "Account"]


def sentence(i):
    n = NAMES[i % 5]
    return [f"The guard of {n}Service was removed in version {i % 9}.", f"Nothing suggests that {n} is cleaned on the way.", f"Each {n} passes the argument without a check."][i % 3]


def test_truncation_finds_planted_cuts(spark):
    rows, cut = [], set()
    for i in range(600):
        text = " ".join(sentence(i + k) for k in range(1 + i % 4))
        if i % 10 == 3:
            text = text[: len(text) - random.Random(i).randint(6, 20)].rstrip()
            cut.add(i)
        elif i % 10 == 5:
            text = text.rstrip(".")
        elif i % 10 == 7:
            text = f"Model call {i}/600"
        rows.append((i, "AGENT", text))
    rows += [(1000, "A", '{"tool": "x", "args": ["a", "b'), (1001, "A", '{"tool": "x"}'), (1002, "A", None), (1003, "A", "  "), (1004, "A", "abc�"), (None, "A", "x"), (1001, "A", '{"tool": "x"}')]
    cut |= {1000, 1004}
    java = "void a() {\n    int x = 1;\n    call(x);\n}"
    chunks = [
        (1, "A.java", "METHOD", java, java), (2, "A.java", "METHOD", java, java[:25]), (3, "A.java", "METHOD", java, None), (4, "a.xml", "XML", "<a>\n<b/>\n</a>", "<a>\n<b"), (5, "a.sql", "SQL", "SELECT 1;\nSELECT 2;", "SELECT 3;"),
        (6, "A.java", "METHOD", java.replace("1", "2"), java), (7, "a.yml", "CONFIG", "limit: 1\nname: x\n", "limit: 1\nnam"), (8, None, None, None, None),
    ]
    e = spark.createDataFrame([(*r, "x") for r in rows], "event_id long, agent_type string, message string, kind string")
    c = spark.createDataFrame([(*r, "x") for r in chunks], "id long, file_path string, chunk_type string, content string, base_content string, text string")
    got = {(r.source_table, r.record_id) for r in T.cut_values(e, c).collect()}
    found = {i for s, i in got if s == "agent_event"}
    assert len(found & cut) >= 0.9 * len(cut) and len(found - cut) <= 2
    assert {i for s, i in got if s == "code_chunk"} == {2, 4, 7}
    shares = {(r.source_table, r.kind): (r.records, r.cut_records) for r in T.cut_shares(e, c).collect()}
    assert shares["code_chunk", "METHOD"] == (3, 1)
    assert T.cut_values(e.limit(0), c.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=51, max_size=51))
def test_plan_uses_everything(counts):
    counts = np.array([0, *counts[1:]])
    recipes = P.plan(counts, 50)
    used = np.zeros(51, np.int64)
    for lengths, times in recipes:
        assert sum(lengths) <= 50 and times > 0
        for length in lengths:
            used[length] += times
    assert (used == counts).all()
    total = int((counts * np.arange(51)).sum())
    assert sum(t for _, t in recipes) <= max(1, -(-total // 50)) * 1.2 + 2


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([700, 5, 60, 130, 2048, 5000, 0, None, rng.randint(1, 900)]), "c") for i in range(800)] + [(None, 9, "c"), (3, 700, "c")]
    df = spark.createDataFrame(rows, "doc_id long, tokens int, container string")
    got = P.pack(df).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.container, []).append(r)
    assert all(sum(r.tokens for r in c) <= 2048 and sorted(r.position for r in c) == list(range(len(c))) for c in by.values())
    sizes = {}
    for r in got:
        sizes.setdefault(r.doc_id, []).append(r.tokens)
    for i, n, _ in rows[:800]:
        if i != 3:
            assert sum(sizes[i]) == (n or 0) and (len(sizes[i]) == 1 or n > 2048)
    total = sum(r.tokens for r in got)
    assert len(by) <= total / 2048 * 1.02 + 2
    assert P.pack(df.limit(0)).count() == 0


def test_tokens(spark, tmp_path):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (None, "x")], "doc_id long, text string")
    try:
        got = {r.doc_id: r.tokens for r in P.token_counts(df).collect()}
    except Exception as e:  # noqa: BLE001
        if "No such file" in str(e):
            return
        raise
    assert got == {1: 2, 2: 0, 3: 0}


def brute(docs, items, n):
    out = set()
    for i, text in items:
        w = L.words_of(text or "")
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, t in docs:
            v = L.words_of(t or "")
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


WORDS = st.lists(st.sampled_from("a b c d e zz".split()), max_size=40).map(" ".join)


@settings(max_examples=80, deadline=None)
@given(st.lists(WORDS, max_size=8), st.lists(WORDS, max_size=5))
def test_index_equals_brute_force(docs, items):
    docs, items = list(enumerate(docs)), list(enumerate(items))
    q = L._Query(items, 3)
    held = [(d, *q.symbols(t)) for d, t in docs]
    got = {(d, i) for d, i, _ in q.shard([h for h in held if len(h[1])])}
    assert got == brute(docs, items, 3)


def test_disguises():
    want = "the quick brown fox ab cd".split()
    for text in (
        "The <b>quick</b>&nbsp;brown\n// fox_ab cd", "> the\n> quick​ brown &#102;ox — ab, CD!", '{"t": "the\\nquick \\"brown\\" fox \\u0061b cd"}'.replace('{"t": ', "").rstrip("}"), "the qu­ick <i class='x'>brown</i> fox/ab-cd",
    ):
        assert L.words_of(text) == want, text
    assert L.words_of("List<Ledger39> x") == ["list", "ledger39", "x"]


def test_leaked_rows(spark):
    words = [f"w{i}" for i in range(40)]
    docs = [(1, "x " + " ".join(words[5:17]).upper() + " y"), (2, " ".join(words[5:16])), (3, None), (4, ""), (None, " ".join(words)), (5, "z\n" * 3000 + "<p>" + " <i>".join(words)), (5, "z\n" * 3000 + "<p>" + " <i>".join(words))]
    items = [(7, " ".join(words)), (7, " ".join(words)), (8, "too short"), (9, None), (None, "x")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.words, r.spans[0].first_word) for r in L.leaked_items(d, i).collect())
    assert got == [(1, 7, 12, 1), (5, 7, 40, 3000)]
    assert L.leaked_items(d.limit(0), i).count() == 0 and L.leaked_items(d, i.limit(0)).count() == 0


def test_triple_is_found_behind_many_blocked_ones():
    counts = np.zeros(2049, int)
    short = range(80, 150)
    counts[[1, *short, *(1999 - y for y in short), 500, 600, 900]] = 1
    # the one item of length 1 is held, so the 70 longest first members fail
    assert P._Stock(counts).triple(2000, (1,)) == (900, 600, 500)


def test_trie_equals_brute_force_at_any_depth(spark):
    r = random.Random(5)
    stems = ["a" * 70, "b" * 79, "ab" * 60, "c"]
    words = sorted({r.choice(stems) + "".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(200)})
    rows = [("s", before, w, r.randint(1, 5)) for before in ("", "x ") for w in words]
    wanted = sorted({before + w[: r.randint(1, len(w))] for _, before, w, _ in rows} | {"x " + "zz" * 50, "c", "x c"})
    trie = T._trie(spark.createDataFrame(rows, "source string, before string, word string, n long"), spark.createDataFrame([("s", w) for w in wanted], "source string, node string"))
    got = {r.node: (r.ends, r.below) for r in trie.where("source = 's'").collect()}
    for node in wanted:
        ends = sum(n for _, b, w, n in rows if b + w == node)
        below = sum(n for _, b, w, n in rows if (b + w).startswith(node) and b + w != node and node.startswith(b) and (b or " " not in node))
        assert got.get(node, (0, 0)) == (ends, below), node


def test_last_tokens_reach_as_far_back_as_needed():
    for text in ("see " + "x" * 5000, "a " + "y" * 450 + " " + "z" * 450, "one two", "", "w" * 3000):
        for n in (1, 2):
            assert T._last(T._WORD, text, n) == T._WORD.findall(text)[-n:]


DISGUISED = st.lists(
    st.sampled_from(["Alpha", "b&auml;r", "&amp;lt;x", "<b>bold</b>", "u\\u0041v", "soft\u00adly", "\u0130st", "\u1e9e", "one-two", "// ", "\\n", "_", " ", "&nbsp;", "<!--", "]]>", "a\u200bb", "\\t\\x41"]), max_size=25
)


@settings(max_examples=200, deadline=None)
@given(DISGUISED)
def test_places_are_those_of_the_words(parts):
    text = " ".join(parts)
    words = L.words_of(text)
    begin, end = L.word_places(text)
    assert len(begin) == len(end) == len(words) and all(a < b for a, b in zip(begin, end)) and list(begin) == sorted(begin)
    for w, a, b in zip(words, begin, end):
        assert w in L.words_of(text[a:b]) or "&" in text[a:b] or "\\" in text[a:b] or any(0x200A < ord(c) or c == "\u00ad" for c in text[a:b])


def test_leaked_places_can_be_cut_out(spark):
    item = " ".join(f"w{i}" for i in range(20))
    doc = "Before &amp; here: <b>W0</b> " + item[3:].replace(" ", "&nbsp;") + "! After it."
    rows = L.leaked_items(spark.createDataFrame([(1, doc), (2, "none")], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    [(a, b)] = [(p.begin, p.end) for p in rows[0].places]
    assert doc[:a] + "#" + doc[b:] == "Before &amp; here: <b>#! After it." and len(rows) == 1
