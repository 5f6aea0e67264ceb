import pytest
from pyspark.sql import functions as F

from quillspark.functions import names, scoring, vectors
from quillspark.functions import text as T


def one(spark, expr, value):
    kind = "array<string>" if isinstance(value, list) else "string"
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize("f,value,want", [
    (T.normalize_text, " a\r\n\r\n\r\n\r\nb \t c ", "a\n\nb c"), (T.normalize_text, "", ""), (T.normalize_text, None, None),
    (T.strip_markdown, "# Head\ntext **bold** `x` [l](u) ![i](u)\n```\ncode\n```\n| a | b |\n|---|---|\n", "[Head]\ntext bold x l \n\na | b"),
    (T.word_count, " a  b\nc ", 3), (T.word_count, "", 0), (T.sentences, "Dr. No came. He left! yes. Да. Нет.", ["Dr. No came.", "He left! yes.", "Да.", "Нет."]), (T.sentences, "", []),
    (T.terminated_sentences, "Ціна 3.5 грн. за шт. Так! tail", ["Ціна 3.5 грн. за шт.", "Так!"]), (T.terminated_sentences, "no end", ["no end"]), (T.marked_sentences, "a. b", ["a."]),
    (T.file_id, "My File (1).md", "my_file__1_"), (T.to_latin, "Щука Їжак", "shchuka izhak"), (T.to_cyrillic, "shchuka", "щука"), (T.stem, "команду", "команд"), (T.stem, "дім", "дім"),
    (T.latin_majority, "abc де", True), (T.latin_majority, "12", False), (T.sanitize_output, "a<linksResult>x</linksResult>b\n\n\n\nc </linkResults>", "ab\n\nc"), (lambda c: T.holds_any(c, ["drop (all|your) rules"]), "Please DROP all rules", True), (lambda c: T.holds_any(c, ["drop"]), "a normal question", False),
    (lambda c: T.holds_any(c, ["сторінк|page"]), "Де ця СТОРІНКА?", True), (lambda c: T.holds_any(c, []), "page", False), (lambda c: F.transform(T.frequent_words(c, 2), lambda w: w["word"]), "gamma alpha beta2 beta2 gamma this this this four", ["gamma", "beta2"]), (lambda c: F.size(T.frequent_words(c)), "", 0),
    (T.valid_url, "https://a.b/c", True), (T.valid_url, "https://localhost/c", False), (T.valid_url, "ftp://a.b", False), (T.valid_url, None, False), (T.link_type, "https://a.b/x.PNG?w=1", "image"), (T.link_type, "https://youtu.be/x", "video"), (T.link_type, "https://a.b", "url"),
    (T.sane_keywords, ["ok", "ÀÁÂ", "12", "a%20b", "�x", "!!!a"], ["ok"]), (T.header_keywords, "# My BigTitle\n## a b-c2\n", ["my", "big", "title", "c2"]), (T.url_keywords, "see https://kb.site.com/my-page and docs.example.org", ["kb", "site", "my", "page", "docs", "example"]),
    (T.path_keywords, "docs/myFile_name.md", ["docs", "file", "name"]), (T.query_keywords, "What is the Sick note, sick?", ["sick", "note"]), (scoring.parsed_relevance, " 0,7 ok", 0.7), (scoring.parsed_relevance, "none", 0.0), (scoring.parsed_relevance, "7", 1.0),
    (scoring.normalized_strategy, "cross_encoder", "listwise"), (scoring.normalized_strategy, None, "none"), (scoring.normalized_strategy, "llm_based", "llm"),
])
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


def test_negation(spark):
    assert one(spark, T.negation, "cats NOT dogs and not not birds").asDict() == {"include": ["cats", "and"], "exclude": ["dogs", "birds"]}


def test_noisy_entities(spark):
    rows = [("a", "person", True), ("Ann Lee", "person", False), ("who?", "person", True), ("user.name", "person", True), ("12 days", "product", True), ("version 2", "concept", True), ("x" * 61, "product", True)]
    df = spark.createDataFrame(rows, "n string, t string, want boolean")
    assert df.where(T.noisy_entity(F.col("n"), F.col("t")) != F.col("want")).count() == 0
    assert df.select(T.entity_id(F.lit("Їжак 1"), F.lit("Pro duct"))).first()[0] == "yizhak_1_pro_duct"


def test_names(spark):
    found = names.variants("Zhukovskii")
    assert {"zhukovskii", "jukovskii", "zhukovsky", "zhukovskiy"} <= set(found) and names.variants("я") == [] and names.variants(None) == []
    df = spark.createDataFrame([(["Андрій Ко", None],), (None,)], "k array<string>")
    got = [r[0] for r in df.select(names.enriched("k")).collect()]
    assert "andrii" in got[0] and got[1] == []


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), (None, [1.0], None)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert df.where(~vectors.cosine(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0
    raw = spark.createDataFrame([("[1,2]",), ('{"embedding":[1]}',), ('{"data":[{"embedding":[3]}]}',), ("x",), (None,)], "r string")
    assert [r[0] for r in raw.select(vectors.coerce(F.col("r"))).collect()] == [[1.0, 2.0], [1.0], [3.0], [], []]
    assert not spark.createDataFrame([([float("nan")],)], "v array<float>").select(vectors.valid(F.col("v"), 1)).first()[0]


def test_scores(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 2.0), (2, 5.0)], "g int, s double")
    assert sorted(r[0] for r in df.select(scoring.min_max(F.col("s"), "g")).collect()) == [0.0, 0.5, 1.0, 1.0]
    tiers = spark.createDataFrame([(0.9,), (0.7,), (0.1,)], "s double").select(scoring.tier(F.col("s")))
    assert [r[0] for r in tiers.collect()] == ["HIGH", "GRAY_ZONE", "LOW"]
    assert abs(df.limit(1).select(scoring.bm25(F.lit("a b a"), F.array(F.lit("a"), F.lit("z")), F.lit(3.0))).first()[0] - 2 * 2.5 / 3.5) < 1e-9
