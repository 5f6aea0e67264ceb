import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import answers, chunking, graph, links, matching, retrieval, sessions, tables, understanding


def test_tables(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3), (None, 9, 4)], "k string, t int, v int")
    assert sorted((r.k, r.v) for r in tables.newest(df, "k", "t").collect()) == [("a", 2), ("b", 3)]
    new = spark.createDataFrame([("a", 5, 5), ("c", 5, 6)], "k string, t int, v int")
    assert sorted((str(r.k), r.v) for r in tables.upsert(df, new, "k").collect()) == [("None", 4), ("a", 5), ("b", 3), ("c", 6)]
    assert tables.insert_absent(df, new, "k").count() == 5 and tables.delete(df, new, "k").count() == 2 and tables.lookup(df, new, "k").count() == 2
    assert [r.k for r in tables.page(new, "k", 1, 1).collect()] == ["c"]


@pytest.mark.parametrize("filters,want", [
    ([], {1, 2, 3}), ([{"field": "n", "value": 2}], {2}), ([{"field": "n", "value": 2, "operator": "ne"}], {1, 3}), ([{"field": "n", "value": [1, None], "operator": "in"}], {1}), ([{"field": "n", "value": [None], "operator": "in"}], {1, 2, 3}),
    ([{"field": "n", "value": 1, "operator": "gt"}], {2}), ([{"field": "n", "value": "x", "operator": "gt"}], {1, 2, 3}), ([{"field": "n", "value": 2, "operator": "odd"}], {2}), ([{"field": None, "value": 2}, {"field": "n", "value": None}], {1, 2, 3}),
])
def test_metadata_filter(spark, filters, want):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "i int, n int")
    assert {r.i for r in df.where(tables.metadata_filter(filters)).collect()} == want


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "i int, n int").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(tables.metadata_filter([{"field": "n", "value": 1, "operator": "gte"}])).select("i")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,1)" in plan


def test_meaningful(spark):
    rows = [(1, "short"), (1, "see https://a.b/c"), (1, "[Title]"), (2, "short"), (2, None)]
    df = spark.createDataFrame(rows, "g int, text string")
    assert sorted((r.g, str(r.text)) for r in tables.keep_or_all(df, tables.meaningful(F.col("text"), 10), "g").collect()) == [(1, "see https://a.b/c"), (2, "None"), (2, "short")]


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "BASE_BLOCK", 20)
    rng = np.random.default_rng(4)
    base, asked = rng.normal(size=(90, 5)), rng.normal(size=(17, 5))
    b = spark.createDataFrame([(f"b{i:02d}", v.tolist(), "x") for i, v in enumerate(base)] + [("b00", base[0].tolist(), "y"), ("n", None, "z"), ("e", [], "z")], "id string, v array<double>, qid string")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(99, [float("nan")] * 5)], "q int, v array<double>")
    for metric, near in (("cosine", lambda x: base @ x / np.linalg.norm(base, axis=1)), ("dot", lambda x: base @ x), ("euclid", lambda x: -np.linalg.norm(base - x, axis=1)), ("manhattan", lambda x: -np.abs(base - x).sum(axis=1))):
        found = retrieval.nearest(b, "id", "v", q, "q", "v", 3, 5, metric=metric).collect()
        got = {(r.q, r.rank): r.id for r in found}
        assert len(found) == 51 and all(got[i, n + 1] == f"b{j:02d}" for i, x in enumerate(asked) for n, j in enumerate(np.argsort(-near(x))[:3]))
    assert retrieval.nearest(b.limit(0), "id", "v", q, "q", "v", 3, 5).count() == 0


def test_contains(spark):
    texts = spark.createDataFrame([(1, "Alpha beta"), (2, "xbetax gamma"), (3, None), (4, "")], "id int, text string")
    needles = spark.createDataFrame([("beta",), ("A",), ("alpha beta",), (" ",), (None,), ("zz",)], "needle string")
    assert sorted(map(tuple, matching.contains(needles, texts).collect())) == [("a", 1), ("a", 2), ("alpha beta", 1), ("beta", 1), ("beta", 2)]


def test_fusion_and_merge(spark):
    rows = [(1, "x", "a", 0.9), (1, "x", "b", 0.8), (1, "y", "b", 0.9)]
    df = spark.createDataFrame(rows, "g int, l string, i string, s double")
    fused = {r.i: r.fused for r in retrieval.reciprocal_rank_fusion(df, "g", "l", "i", "s").collect()}
    assert abs(fused["b"] - (1 / 62 + 1 / 61)) < 1e-12 and abs(fused["a"] - 1 / 61) < 1e-12
    merged = {r.i: r.s for r in retrieval.merge_secondary(df.where("l = 'x'"), df.where("l = 'y'"), "g", "i", "s").collect()}
    assert abs(merged["b"] - (0.8 + 0.9 * 0.9 / 61)) < 1e-12


def test_parents(spark):
    results = spark.createDataFrame([(1, "a", "c1", "p", None, 1), (1, "b", "c2", "p", "own", 2), (1, "c", "c1", "p", None, 3), (1, "d", "alone", None, None, 4), (1, "e", "x", "q", "stored", 5)], "g int, id string, text string, parent_id string, parent_text string, o int")
    parents = spark.createDataFrame([("p", "P")], "chunk_id string, text string")
    found = {r.id: r.text for r in retrieval.expand_parents(results, parents, "g", "o").collect()}
    assert found == {"a": "P\n\nc1\n\nc2", "d": "alone", "e": "stored\n\nx"}


def test_entity_tiers(spark):
    rows = [(1, "Anna Shevchenko", 0.9), (1, "Anna only", 0.8), (2, "Шевченко тут", 0.9), (2, "nobody", 0.8), (3, "x", 0.9), (3, "y", 0.8)]
    df = spark.createDataFrame(rows, "q int, text string, s double")
    groups = F.array(F.array(F.lit("anna")), F.array(F.lit("shevchenko")))
    found = sorted((r.q, r.text, r.fallback) for r in retrieval.entity_filter(df, groups, "q", [F.desc("s")], 1).collect())
    assert found == [(1, "Anna Shevchenko", False), (2, "Шевченко тут", False), (3, "x", True)]


def test_images(spark):
    images = spark.createDataFrame([(1, "a", ["Cat"], 0.9), (1, "b", ["cats"], 0.5), (1, "c", ["dog"], 0.1), (1, "d", None, 0.2)], "query_id int, id string, keywords array<string>, score double")
    asked = spark.createDataFrame([(1, ["cat"], ["dog"])], "query_id int, include array<string>, exclude array<string>")
    assert [(r.id, round(r.score, 6)) for r in sorted(retrieval.image_search(images, asked).collect(), key=lambda r: r.rank)] == [("a", 1.2), ("b", 0.9), ("d", 0.4), ("c", 0.0)]


def test_chunking(spark):
    docs = spark.createDataFrame([(1, "One two three. Four five. Six seven eight nine.\n\nTen."), (2, None), (3, "")], "k int, t string")
    packed = [r.chunk for r in chunking.sentence_chunks(docs, "k", "t", least=2, most=5, shortest=1).orderBy("k", "pos").collect()]
    assert packed == ["One two three. Four five.", "Six seven eight nine. Ten."]
    lapped = [r.chunk for r in chunking.overlapping_chunks(docs, "k", "t", 2, 5, 1, False).orderBy("pos").collect()]
    assert lapped == ["One two three. Four five.", "five. Six seven eight nine.", "nine. Ten."]
    sem = chunking.semantic_chunks(docs, "k", "t", least=1, alike=2.0).orderBy("pos").collect()
    assert [r.chunk for r in sem] == ["One two three.", "Four five.", "Six seven eight nine.", "Ten."]


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\ntext\n### deep\n## B\nmore"), (2, "# Only"), (3, "plain")], "k int, t string")
    found = [(r.k, r.header, r.body) for r in chunking.sections(docs, "k", "t").orderBy("k", "pos").collect()]
    assert found == [(1, None, "intro"), (1, "# A", "# A\ntext\n### deep"), (1, "## B", "## B\nmore"), (2, "# Only", "# Only"), (3, None, "plain")]


def test_families(spark):
    text = "# One\n" + "Word word word. " * 60 + "\n## Two\nShort."
    docs = spark.createDataFrame([(1, "f", text, 9), (2, None, "", 9), (3, "", None, 9), (4, None, "plain", 9), (5, "g", "# A\r\n\r\n \n# B", 9)], "k int, f string, t string, part int")
    rows = chunking.parent_child_chunks(docs, "k", "f", "t", 400, 120, 30).collect()
    assert {r.k for r in rows} == {1, 4, 5} and {r.chunk_id for r in rows if r.k == 4} == {"doc_p0", "doc_p0_c0"}
    assert {(r.chunk_id, r.section_title) for r in rows if r.k == 5 and r.level == 0} == {("g_p0", "# A"), ("g_p1", "# B")}
    mine = [r for r in rows if r.k == 1]
    parents, kids = [r for r in mine if r.level == 0], [r for r in mine if r.level == 1]
    assert all(len(r.text) <= 400 for r in parents) and all(len(r.text) <= 120 for r in kids) and {r.parent_id for r in kids} <= {r.chunk_id for r in parents}
    assert all(text[r.start_index : r.end_index].strip() == r.text for r in kids) and parents[-1].section_title == "## Two"
    with pytest.raises(ValueError):
        chunking.parent_child_chunks(spark.createDataFrame([(1, "f", "t")], "k int, f string, t string"), "k", "f", "t", child_size=10, overlap=10)


def test_spans():
    text = "One two. Three four five six seven eight nine ten."
    assert "".join(text[a:b] for a, b in chunking.spans(text, 9, window=5)) == text and chunking.spans(text, 9, window=5)[0] == (0, 8)
    assert chunking.spans("x" * 25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)] and chunking.spans("", 5) == []
    lapped = chunking.spans("Word word word. " * 100, 120, 30)
    assert all(b > a and 0 < b - a <= 120 for a, b in lapped) and all(c < b for (a, b), (c, _) in zip(lapped, lapped[1:])) and lapped[-1][1] == 1600


def test_links(spark):
    text = "See [the wiki](https://a.b/wiki) and https://a.b/wiki or <https://c.d/v.mp4>.\n\n![](https://e.f/i.png) [m](mailto:x@y.z) [top](#top)"
    docs = spark.createDataFrame([(1, text), (2, None)], "k int, t string")
    found = {(r.url, r.label, r.link_type) for r in links.extract(docs, "k", "t").collect()}
    assert found == {("https://a.b/wiki", "the wiki", "url"), ("https://c.d/v.mp4", "https://c.d/v.mp4", "video"), ("https://e.f/i.png", "image", "image")}
    near = spark.createDataFrame([(text,)], "t string").select(links.context(F.col("t"), F.lit(5))).first()[0]
    assert near.startswith("See [the wiki]") and "mailto" not in near


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("c", "a", "Y"), ("c", "d", "X"), ("a", "a", "X"), ("a", "z", "X")], "src string, dst string, type string")
    ents = spark.createDataFrame([(i, i.upper(), "t") for i in "abcd"] + [("a", "Z", "t")], "id string, name string, type string")
    e, g = graph.merge(ents, edges)
    assert e.count() == 4 and g.count() == 5
    found = sorted(map(tuple, graph.neighbourhood(g, spark.createDataFrame([("a",)], "id string"), 2).collect()))
    assert found == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]
    assert graph.stats(e, g).first().asDict() == {"entities": 4, "edges": 5, "by_type": {"t": 4}} and graph.stats(e, g.limit(0)).first()["entities"] == 0
    kept, left = graph.delete(e, g, spark.createDataFrame([("c",)], "id string"))
    assert kept.count() == 3 and sorted((r.src, r.dst) for r in left.collect()) == [("a", "a"), ("a", "b")]
    block = graph.render(e.withColumn("g", F.lit(1)), g.where("src <> dst"), "g").first()["block"]
    assert block.startswith("A is a t (connected via: X, Y). ") and block.endswith(".")


def test_sessions(spark):
    T = dt.datetime(2024, 1, 1)
    turns = spark.createDataFrame([(f"t{i}", f"s{i % 2}", "q" * (i * 10), T + dt.timedelta(hours=i)) for i in range(10)] + [("n", "s0", None, None)], "id string, session_id string, query string, ts timestamp")
    assert sorted(r.id for r in sessions.prune(turns, 2).collect()) == ["t6", "t7", "t8", "t9"]
    assert [(r.id, r.pos) for r in sessions.history(turns, 2).orderBy("session_id", "pos").collect()] == [("t6", 1), ("t8", 2), ("t7", 1), ("t9", 2)]
    heads = {r.session_id: (len(r.first_message), r.turn_count) for r in sessions.session_list(turns, 4).collect()}
    assert heads == {"s0": (61, 2), "s1": (61, 2)}
    assert sessions.without_old(turns, T + dt.timedelta(hours=8)).count() == 2


def test_histogram_and_evaluation(spark):
    df = spark.createDataFrame([(1, x) for x in (0.1, 0.2, 0.35, 0.4, 0.9)] + [(2, float("nan")), (3, 0.5), (3, 0.5)], "g int, s double")
    rows = {r.g: r for r in sessions.histogram(df, "g", "s").collect()}
    assert 2 not in rows and (rows[1].median, rows[1].p75, rows[1].counts) == (0.35, 0.4, [2, 2, 0, 0, 1]) and rows[3].counts == [2, 0, 0, 0, 0]
    fb = spark.createDataFrame([("f", "Approved", 5, None), ("g", "pending", 1, None), ("h", "approved", None, "x")], "id string, status string, score int, correction_text string")
    cases = sessions.evaluation_cases(fb)
    assert sorted((r.id, r.grounded, r.coverage, r.score) for r in cases.collect()) == [("feedback-f", True, 0.7, 1.0), ("feedback-h", False, 0.9, 0.5)]
    assert not sessions.evaluate(cases.limit(0)).first()["passed"]


def test_answers(spark):
    results = spark.createDataFrame([(1, i, 0.1 * i) for i in (1, 2, 3)] + [(2, 1, 0.7)], "g int, pos int, score double")
    said = spark.createDataFrame([(1, "here: [3, 1, 9]"), (2, "sorry")], "g int, answer string")
    assert [round(r.rerank_score, 4) for r in answers.listwise(results, said, "g").orderBy("g", "pos").collect()] == [0.6667, 0.0, 1.0, 0.7]
    pairs = spark.createDataFrame([(1, "red car", "A blue sky. The red car stops. A car."), (2, "x", "")], "k int, q string, b string")
    found = {r.k: r.compressed for r in answers.compress(pairs, ["k"], "q", "b", budget=7).collect()}
    assert found[1].strip() == "The red car stops.  A car." or "The red car stops." in found[1]
    docs = spark.createDataFrame([(1, 0, "d1", "Completely different words stand here."), (1, 1, "d2", "The safety quiz ends on Friday. Short.")], "g int, doc_pos int, id string, text string")
    ans = spark.createDataFrame([(1, "Note: The safety quiz ends on Friday, so hurry.")], "g int, answer string")
    cites = answers.citations(ans, docs, "g")
    assert [(r.number, r.id) for r in cites.collect()] == [(1, "d2")]
    ans2 = spark.createDataFrame([(1, "Note: The safety quiz ends on Friday. Hurry.")], "g int, answer string")
    assert answers.cited(ans2, answers.citations(ans2, docs, "g"), "g").first()["formatted"] == "Note: The safety quiz ends on Friday. [1] Hurry."


def test_grounding(spark):
    rows = spark.createDataFrame([(0.9, "HIGH", 0.0), (0.7, "GRAY_ZONE", 0.7), (0.7, "GRAY_ZONE", 0.1), (0.1, "LOW", 1.0)], "s double, t string, o double")
    g, v = answers.verify(F.col("s"), F.col("t"), F.col("o"))
    text, ok = answers.final_answer(F.lit("yes"), F.col("g"), F.col("t"), F.col("v"))
    found = rows.withColumns({"g": g, "v": v}).select(text.alias("a"), ok.alias("k"), "v").collect()
    assert [(r.a == "yes", r.k, r.v) for r in found] == [(True, True, None), (True, True, "YES"), (False, False, "NO"), (False, False, None)]


def test_understanding(spark):
    rules = [("factual", "^when", None), ("wide", "about", r"\d"), ("factual", "about", None)]
    rows = [("When, about now?", "factual"), ("Tell me ABOUT it", "wide"), ("tell me about 12", "factual"), ("hello", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "q string, want string")
    assert [(r.q, r.k) for r in df.withColumn("k", understanding.kind(F.col("q"), rules)).collect()] == rows
    said = spark.createDataFrame([("when?", '{"type": "wide", "confidence": 0.2}'), ("x link", 'so: {"type": "entity", "confidence": 0.8}'), ("x", "{broken"), ("x", '{"type": "poem"}'), (None, None)], "q string, a string")
    found = understanding.classified(said, "q", rules, "a", ["link"]).collect()
    assert [(r.kind, r.confidence, r.search_mode) for r in found] == [("factual", 1.0, "balanced"), ("entity", 0.8, "entity"), ("factual", 0.5, "balanced"), ("factual", 0.5, "balanced"), ("factual", 0.5, "balanced")]
    words = df.limit(1).select(understanding.expand(F.lit("Sick note for команди"), {"sick note": ["medical leave"], "команд": ["Team"]})).first()[0]
    assert set(words) == {"sick", "note", "for", "команди", "medical leave", "team"}


def test_hybrid_search_scores_all_keyword_matches(spark):
    rows = [(f"c{i:04d}", "alpha " + f"word{i} " * 30, [1.0, 0.0, 0.0] if i < 3 else None) for i in range(600)] + [("z", "alpha " * 30, None)]
    chunks = spark.createDataFrame(rows, "id string, text string, embedding array<float>").selectExpr("*", "'' AS parent_text", "array() :: array<string> AS context_keywords", "1 AS level", "length(text) AS text_length")
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0], ["alpha"])], "query_id int, vector array<float>, keywords array<string>")
    assert "z" in {r["id"] for r in retrieval.hybrid_search(chunks, asked, 4, size=3).collect()}
    assert "z" not in {r["id"] for r in retrieval.hybrid_search(chunks, asked, 4, size=3, keyword_limit=500).collect()}
    assert retrieval.keyword_matches(chunks, asked).count() == 601 and retrieval.keyword_matches(chunks, asked, 500).count() == 500
