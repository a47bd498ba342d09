"""The two fitted models: planted corpora, held-out agreement, awkward rows."""

import random

from slatewing.llm import handwritten as H
from slatewing.llm import queries
from slatewing.llm import subjects as S


def source(i):
    r = random.Random(i)
    names = [r.choice(["order", "invoice", "user", "stock"]) for _ in range(6)]
    if i % 3 == 0:
        head = "// Code generated by tool. DO NOT EDIT.\n" if i % 2 else ""
        body = "".join(f"  public static final int {n.upper()}{k}_FIELD_NUMBER = {k};\n  private int bitField{k}_;\n" for k, n in enumerate(names))
        return f"src/main/java/a/proto/{names[0].title()}{i}.java", f"{head}package a.proto;\nclass X{i} {{\n{body}}}\n", True
    body = "".join(f"    public void {n}{k}() {{\n        for (Row r : {n}Mapper.list()) {{ r.set{n.title()}({k}); }}\n    }}\n" for k, n in enumerate(names))
    return f"src/main/java/a/service/{names[0].title()}{i}.java", f"package a.service;\nclass X{i} {{\n{body}}}\n", False


def test_files_not_handwritten(spark):
    rows, want = [], set()
    for i in range(240):
        path, text, made = source(i)
        rows.append((i, f"t{i % 12}", path.replace("/", "\\") if i % 7 == 0 else path, text, "clash"))
        if made:
            want.add((f"t{i % 12}", rows[-1][2]))
    rows += [(900, None, "a.java", "x", ""), (901, "t1", None, "x", ""), (902, "t1", "a.java", None, ""), (903, "t1", "b.java", "", ""), rows[0]]
    c = spark.createDataFrame(rows, "id long, task_id string, file_path string, content string, label string")
    t = spark.createDataFrame([(f"t{i}", f"p{i % 6}", 1) for i in range(12)], "id string, project_id string, version int")
    got = [(r.task_id, r.file_path) for r in H.files_not_handwritten(c, t).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) & want) >= 0.95 * len(want) and len(set(got) - want) <= 4
    model = H.fit(c, t)
    assert model.held_out_rows > 0
    assert H.files_not_handwritten(c.limit(0), t).count() == 0


AREAS = {"LAW": "court clause statute notary deadline contract".split(), "FARMING": "herd harvest tractor soil silo crop".split(), "ENERGY": "turbine grid meter boiler battery outage".split()}


def document(i):
    r = random.Random(i)
    area = list(AREAS)[i % 3]
    out = [f"The {r.choice(AREAS[area])} of the {r.choice(AREAS[area])} links to one {r.choice(AREAS[area])}." for _ in range(6)]
    return area, " ".join(out + ["A guard on the caller would be enough here."] * 2)


def test_document_areas(spark):
    docs = [(i, document(i)[1], "c") for i in range(240)] + [(900, None, "c"), (901, " \n", "c"), (902, "12 34", "c"), (None, "court clause", "c"), (3, document(3)[1], "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, area_code string")
    labels = spark.createDataFrame([(i, document(i)[0] if i % 9 else "LAW") for i in range(0, 240, 4)] + [(None, "LAW"), (7, None)], "doc_id long, area_code string")
    subjects = spark.createDataFrame([(a, a.lower(), " ".join(w[:2])) for a, w in AREAS.items()] + [("SPORT", "sport", "clubs")], "area_code string, area_name string, description string")
    model, encoded = S.fit_areas(d, labels, subjects, set())
    assert model.areas == sorted([*AREAS, "SPORT"]) and encoded.count() >= 240
    got = {}
    for r in S.document_areas(d, labels, subjects).collect():
        got.setdefault(r.doc_id, set()).add(r.area_code)
    right = sum(got.get(i) == {document(i)[0]} for i in range(240))
    assert right >= 228 and not set(got) & {900, 901, 902, None}
    assert S.document_areas(d.limit(0), labels, subjects).count() == 0
    empty = {r.area_code: (r.documents, r.share) for r in S.corpus_makeup(d.limit(0), labels, subjects).collect()}
    assert empty == {a: (0, 0.0) for a in model.areas}


def test_words_of_a_large_area_are_kept(spark, monkeypatch):
    """Words that stand in most documents stay if rated documents show that they speak for an area."""
    monkeypatch.setattr(S, "ROUNDS", 1)
    own = [i for i in range(360) if i % 3 == 0 or i % 9 == 1 or i % 9 == 2]  # LAW holds most documents
    d = spark.createDataFrame([(i, document(i)[1]) for i in own], "doc_id long, text string")
    labels = spark.createDataFrame([(i, document(i)[0]) for i in own if i % 2], "doc_id long, area_code string")
    subjects = spark.createDataFrame([(a, a.lower(), "") for a in AREAS], "area_code string, area_name string, description string")
    model, _ = S.fit_areas(d, labels, subjects, set())
    words = {w for w in model.words if " " not in w}
    assert {w for own in AREAS.values() for w in own} <= words
    assert not words & {"the", "links", "one", "guard", "caller", "would", "here", "enough"}


def test_topics_are_mapped_by_their_top_terms(spark):
    d = spark.createDataFrame([(i, document(i)[1]) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, document(i)[0]) for i in range(0, 120, 4)], "doc_id long, area_code string")
    subjects = spark.createDataFrame([(a, a.lower(), "") for a in AREAS] + [("SPORT", "sport", "clubs")], "area_code string, area_name string, description string")
    model, tokenised = S.fit_areas(d, labels, subjects, set())
    for topic, area, terms in model.topic_terms:
        assert area == "" or set(terms[:6]) == set(AREAS[area])
    assert {a for _, a, _ in model.topic_terms} == {*AREAS, ""}
    for r in S.area_shares(tokenised, model).collect():
        assert (r.area_code, r.sentences, r.of_sentences, r.share) == (document(r.doc_id)[0], 6, 8, 0.75)


def test_areas_without_labels(spark):
    """Descriptions alone start the topics; documents of other words have no area."""
    d = spark.createDataFrame([(i, document(i)[1]) for i in range(90)] + [(99, "Nothing of that here. Or there either.")] * 3, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, area_code string")
    subjects = spark.createDataFrame([(a, a.lower(), " ".join(w[:3])) for a, w in AREAS.items()], "area_code string, area_name string, description string")
    got = {(r.doc_id, r.area_code) for r in S.document_areas(d, none, subjects).collect()}
    assert got == {(i, document(i)[0]) for i in range(90)}


def test_queries_run(spark, sf_dir):
    for name in ("p1_found", "p3_found", "p4_found", "p4_pieces", "p5_found", "p6_containers", "p7_found"):
        df = queries.QUERIES[name](spark, sf_dir)
        assert df.count() == df.distinct().count() > 0
