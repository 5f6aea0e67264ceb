"""Operators around a search: variants, reranking, models, links, streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import names
from quillspark.operators import answers, cache, links, matching, models, querying, reranking, retrieval, sessions, tables
from quillspark.plans import ingest
from quillspark.sources.store import Store
from quillspark.streaming import answers as S


def test_question_variants(spark):
    rows = spark.createDataFrame([("Хто такий Петро Шевченко?", True, None), ("how do I get leave now", False, "a\n\n how do I get leave now \nb\nc\nd"), ("short one", False, "x\ny"), ("", False, None), (None, True, None)], "q string, e boolean, s string")
    q = F.col("q")
    got = rows.select(querying.expanded(q, F.col("e"), F.col("s"), ["хто"]).alias("x"), querying.rephrased(q, F.col("e"), F.col("s")).alias("r")).collect()
    assert got[0].x == ["Khto такий Petro Shevchenko", "Шевченко?", "Петро"] and got[1].x == ["a", "b", "c"] and got[1].r == ["a", "b", "c", "d"] and got[2].r == [] and got[3].x == []
    found = rows.select(querying.variants(q, F.array(F.lit("e1"), F.lit("e2"), F.lit("e3")), F.array(F.lit("r1"), F.lit("r2")), F.array(F.lit("t"), F.lit("e1")), F.array(F.lit("h"))).alias("v")).collect()
    assert found[1].v == ["how do I get leave now", "e1", "e2", "r1", "t", "h"] and found[2].v == ["short one", "e1", "t", "h"] and found[3].v == ["e1", "t", "h"]
    words = spark.range(1).select(querying.keywords(F.lit("x"), F.lit(False), F.array(F.lit("a"), F.lit("b")), F.lit(" C ,, a")).alias("k"), querying.keywords(F.lit("x"), F.lit(False), F.array(F.lit("a")), F.lit(None).cast("string")).alias("n")).first()
    assert words.k == ["a", "b", "c"] and words.n == ["a"]


def test_rerank(spark):
    rows = spark.createDataFrame([(g, f"r{i}", s, 1.0 - s, 7) for g in (1, 2, 3) for i, s in enumerate((0.9, 0.5, 0.012))] + [(4, "a", None, None, 7)], "g int, r string, score double, other double, n int")
    strategy = F.when(F.col("g") == 1, "llm_based").when(F.col("g") == 2, "none").otherwise("hybrid")
    found = reranking.rerank(rows, "g", "r", strategy, F.lit("balanced"), F.lit(2), {"llm": F.col("other")}, F.col("g") != 3).collect()
    by = {(x.g, x.r): x for x in found}
    assert [r for (g, r) in sorted(by) if g == 1] == ["r1", "r2"] and by[1, "r2"].score == 0.988 and by[1, "r2"].rank == 1
    assert {r for g, r in by if g == 2} == {"r0", "r1", "r2"} and {r for g, r in by if g == 3} == {"r0", "r1", "r2"} and not by[3, "r0"].reranked and (4, "a") not in by
    assert spark.range(1).select(reranking.kept(F.lit("entity"), F.lit(3)), reranking.kept(F.lit("entity"), F.lit(10)), reranking.kept(F.lit("wide"), F.lit(3))).first()[:] == (24, 40, 3)
    assert reranking.rerank(rows.limit(0), "g", "r", strategy, F.lit("balanced"), F.lit(2), {}).count() == 0


def test_order_by_names(spark):
    rows = spark.createDataFrame([(1, "a", "about Oksana", 0.1), (1, "b", "nothing", 0.9), (1, "c", "Оксана Koval", 0.2), (1, "d", None, 1.0)], "g int, r string, text string, score double")
    groups = F.array(F.array(F.lit("оксана"), F.lit("oksana")), F.array(F.lit("koval")))
    found = reranking.by_names(rows, "g", "r", groups).orderBy("place").collect()
    assert [x.r for x in found][:2] == ["c", "a"] and [x.matches for x in found][:3] == [2, 1, 0]
    tokens = spark.createDataFrame([("Хто Оксана?",), (None,)], "q string").select(names.query_token_groups(F.col("q"), ["хто"]).alias("t")).collect()
    assert len(tokens[0].t) == 1 and "oksana" in tokens[0].t[0] and tokens[1].t == []


def test_model_port(spark):
    def bad(prompts):
        if "x" in prompts:
            raise RuntimeError
        return [p.upper() if p != "none" else None for p in prompts]

    run = models.routed(bad, lambda ps: [f"2{p}" for p in ps])
    assert run(["a", "x", "none"]) == ["A", "2x", "2none"] and run([]) == [] and models.routed(bad)(["x"]) == [None]
    df = spark.createDataFrame([("a",), (None,), ("a",)], "p string")
    assert [r[0] for r in df.select(models.completed(F.col("p"), models.routed(bad))).collect()] == ["A", None, "A"]
    said = spark.createDataFrame([("Plan, ab,report\nplan", "t"), (None, "longer words longer"), ("", "")], "s string, t string").select(models.model_keywords(F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in said] == [["plan", "report"], ["longer", "words"], []]


def test_links_for_questions(spark):
    rows = [("1", "https://a.b/x", "Guide", None, "f", ["guide"], "url"), ("2", "nohost", "Guide two", None, "f", ["guide"], "url"), ("3", "https://c.d/y", None, "the guide here", "g", None, "image")]
    table = spark.createDataFrame(rows, "id string, url string, label string, context string, source_file string, keywords array<string>, link_type string").withColumn("created_at", F.lit(dt.datetime(2024, 1, 1)))
    asked = spark.createDataFrame([(1, "Link of the guide?"), (2, "guide"), (3, "link to nothing"), (4, None), (5, "")], "query_id int, query string")
    found = {r.query_id: r for r in links.find(table, asked, 4, ["link"]).collect()}
    assert found[1].found and found[1].block == "Guide**: https://a.b/x" and not found[2].found and found[3].found and found[3].links == 0 and not found[4].found
    wide = {r.query_id: r for r in links.find(table, asked, 0).collect()}
    assert wide[2].links == 2 and not wide[3].found and not wide[5].found
    again = links.reindexed(table, table.where("id = '1'").withColumn("id", F.lit("9")))
    assert sorted(r.id for r in again.collect()) == ["3", "9"]


def test_streams(spark):
    first = spark.createDataFrame([(1, 0, "metadata", "m"), (1, 1, "token", "a"), (1, 2, "error", None), (2, 0, "token", "x\ny"), (2, 1, "done", None), (2, 2, "token", "late")], "k int, seq int, event string, payload string")
    second = spark.createDataFrame([(1, 0, "metadata", "m"), (1, 1, "token", "b"), (1, 2, "done", None), (2, 0, "token", "unused")], "k int, seq int, event string, payload string")
    both = S.with_fallback(first, second, "k")
    assert [(r.k, r.event, r.payload) for r in both.where("k = 1").orderBy("seq").collect()] == [(1, "metadata", "m"), (1, "token", "a"), (1, "token", "b"), (1, "done", None)]
    frames = [r.frame for r in S.frames(both, "k").where("k = 2").orderBy("seq").collect()]
    assert frames == ["event: token\ndata: x\ndata: y\n\n", "event: done\ndata: {}\n\n"]
    verdicts = spark.createDataFrame([(1, True), (2, False)], "k int, grounded boolean")
    assert [tuple(r) for r in S.settled(both, verdicts, "k").collect()] == [(1, "ab")]
    pieces = spark.createDataFrame([(1, 2, "}\n{"), (1, 1, '{"a'), (1, 3, "b}"), (2, 1, None)], "k int, n int, c string")
    assert sorted(map(tuple, S.lines(pieces, "k", "n", "c").collect())) == [(1, 0, '{"a}'), (1, 1, "{b}")]


def test_contains_by_words_equals_automaton(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"Word{i % 7} xbetax Gamma-{i}", 1) for i in range(40)] + [(99, None, 1)], "id int, text string, needle int")
    needles = spark.createDataFrame([("beta",), ("ord3",), ("gamma-1",), ("x gamma",), (" ",), (None,)], "needle string")
    one = sorted(map(tuple, matching.contains(needles, texts, n=F.length("text")).collect()))
    monkeypatch.setattr(matching, "MOST_NEEDLES", 1)
    assert one == sorted(map(tuple, matching.contains(needles, texts, n=F.length("text")).collect())) and len(one) > 60
    assert matching.contains(needles.limit(0), texts, n=F.length("text")).count() == 0


def test_keyword_phrases_and_features(spark):
    got = spark.createDataFrame([(["Time Off", "x"],), ([],)], "k array<string>").select(retrieval.expanded_keywords(F.col("k"), {"time off": ["Vacation"]})).collect()
    assert got[0][0] == ["time off", "time", "off", "x", "vacation"] and got[1][0] == []
    chunks = spark.createDataFrame([("a", "see https://x.time.org time", None), ("b", None, ["My Time"]), ("c", "none", ["z"])], "id string, text string, context_keywords array<string>")
    pairs = spark.createDataFrame([(i, "time") for i in "abca"] + [("a", "")], "id string, needle string")
    assert sorted(map(tuple, retrieval.keyword_features(pairs, chunks).collect())) == [("a", "time", 2, True), ("b", "time", 0, False)]


def test_sessions_and_cache(spark):
    turns = spark.createDataFrame([("a", "s"), ("b", "t"), ("c", None)], "id string, session_id string")
    assert {r.id for r in sessions.cleared(turns, turns.where("id = 'a'")).collect()} == {"b", "c"} and sessions.cleared(turns).count() == 0
    fb = spark.createDataFrame([("x", "s", "approved", None, None)], "id string, session_id string, status string, created_at timestamp, updated_at timestamp")
    made = sessions.created(fb, fb.select(F.lit("y").alias("id"), "session_id"), dt.datetime(2024, 1, 1)).where("id = 'y'").first()
    assert made.status == "pending" and made.created_at == dt.datetime(2024, 1, 1)
    keys = [r[0] for r in spark.range(1).select(F.explode(F.array(cache.key(F.lit("Q  a")), cache.key(F.lit("q A")), cache.key(F.lit("q a"), group="class")))).collect()]
    assert keys[0] == keys[1] and keys[0].startswith("answer:") and keys[2].startswith("class:")
    store = spark.createDataFrame([(k, "v") for k in set(keys)], "key string, value string")
    assert [r.key for r in cache.invalidate(store, "answer:").collect()] == [keys[2]]


def test_verification_and_compression(spark):
    rows = spark.createDataFrame([("x", ["", "s"], ["c"]), ("x", None, ["c"]), ("", ["s"], None), (None, None, None)], "a string, s array<string>, c array<string>")
    got = rows.select(answers.verified_texts(F.col("s"), F.col("c")).alias("t"), answers.grounded_answer(F.col("a"), F.col("s"), F.col("c"), F.lit(False), F.lit("LOW"), F.lit(None).cast("string")).alias("g")).collect()
    assert [r.t for r in got] == [["s"], ["c"], ["s"], []] and [r.g for r in got] == [answers.FALLBACK, answers.FALLBACK, "", None]
    texts = spark.createDataFrame([(1, "team", "The wonderful team. " * 60, "brief", "wide"), (2, "team", "The wonderful team. " * 60, None, "wide"), (3, "team", "One team. Two.", "brief", "wide"), (4, "team", "The wonderful team. " * 60, "brief", "entity"), (5, None, None, None, None)], "k int, q string, b string, s string, m string")
    out = {r.k: r.compressed for r in answers.compress_hybrid(texts, ["k"], "q", "b", "s", "m", 5).collect()}
    assert out[1] == "brief" and out[2] == "The wonderful team. " * 60 and out[3] == "One team.  Two." and out[4] == "The wonderful team. " * 60 and out[5] is None


def test_names_do_not_mix_files(spark):
    text = "# Guide\n" + "Team leads must archive the access ticket. " * 12 + "Zebra zebra zebra zebra."
    files = spark.createDataFrame([("a/README.md", "README.md", text, text), ("b/README.md", "README.md", text.replace("Zebra", "Tiger"), text.replace("Zebra", "Tiger")), ("c.md", "c.md", None, None)], "path string, name string, raw string, text string")
    rows = ingest.ingest(files, "parent_child").collect()
    assert len({r.id for r in rows}) == len(rows) == 4 and len({r.file_id for r in rows}) == 2 and all(r.file_id.startswith("readme_") for r in rows)
    words = " ".join(["first"] + [f"word{i:02d}x" for i in range(15)] + ["frequent"] * 40)
    kept = spark.createDataFrame([("n.md", words, words)], "name string, raw string, text string").select(ingest.file_keywords(F.col("name"), F.col("raw"), F.col("text"))).first()[0]
    assert kept[0] == "frequent"


def test_delete_by_file(spark):
    rows = spark.createDataFrame([("1", "f"), ("2", "g"), ("3", None)], "id string, file_id string")
    assert {r.id for r in tables.delete(rows, spark.createDataFrame([("f",), (None,)], "file_id string"), "file_id").collect()} == {"2", "3"}


def test_approximate_search(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 8))[rng.integers(0, 30, 900)] + 0.2 * rng.normal(size=(900, 8))
    rows = [(f"b{i:03d}", v.tolist(), 1) for i, v in enumerate(x)] + [("b000", x[0].tolist(), 1), ("n", None, 1), ("z", [0.0] * 8, 1), ("s", [1.0], 1)]
    base = spark.createDataFrame(rows, "id string, v array<double>, cell int")
    asked = spark.createDataFrame([(i, (x[i * 7] + 0.05).tolist(), 1) for i in range(40)] + [(99, None, 1)], "q int, v array<double>, part int")
    same = lambda a: sorted((r.q, r.id) for r in a.collect())
    true = same(retrieval.nearest(base.where("id <> 'z'"), "id", "v", asked, "q", "v", 5, 8))
    assert same(retrieval.nearest_approximate(base, "id", "v", asked, "q", "v", 5, 8, probes=16, cells=16)) == true
    monkeypatch.setattr(retrieval, "CELL_ROWS", 20)
    found = same(retrieval.nearest_approximate(base, "id", "v", asked, "q", "v", 5, 8, probes=4, cells=16))
    assert len(found) == len(true) == 200 and len(set(found) & set(true)) >= 0.9 * len(true)
    assert retrieval.nearest_approximate(base.limit(0), "id", "v", asked, "q", "v", 5, 8).count() == 0


def test_strong_results_and_rerank_by_vectors(spark):
    rows = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1), (2, "a", 0.2), (2, "b", 0.1), (2, "c", None), (3, "a", 0.1)], "g int, r string, s double")
    assert sorted((x.g, x.r) for x in retrieval.strong(rows, "g", "r", "s", 0.5, F.col("g") < 3, 2).collect()) == [(1, "a"), (2, "a"), (2, "b"), (3, "a")]
    v = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0], None), ([1.0, 0.0], [], [0.0, 1.0]), ([1.0, 0.0], None, None), (None, [1.0], [1.0])], "q array<double>, s array<double>, e array<double>")
    assert [r[0] for r in v.select(answers.embedding_rerank(F.col("q"), F.col("s"), F.col("e"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_store_checks_sizes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "id string, v array<double>")
    store.upsert(rows, "id", {"v": 2})
    with pytest.raises(Exception, match="has not 3 values"):
        store.write(rows, sizes={"v": 3})
    assert len(store.versions()) == 1 and store.read().count() == 2
