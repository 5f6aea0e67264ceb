import pytest

from quillspark.llm import language, queries


@pytest.fixture(scope="module")
def model(spark, sf):
    return queries.language_model(spark, "/root/testdata/sf0.01")


def detect(spark, model, texts, **kw):
    df = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(texts)], "k int, t string, lang string")
    return [r for r in sorted(language.detect(df, ["k"], "t", model, **kw).collect(), key=lambda r: r["k"])]


def test_languages(spark, model):
    texts = [
        "Team leads must archive the access ticket at the front desk.", "Працівники складу повинні перевірити запит на доступ у перший день.", "Работники склада должны переслать заявку на бейдж до конца месяца.",
        "Pracownicy magazynu muszą podpisać wniosek o urlop w recepcji.", "Lagerkräfte müssen den Urlaubsantrag am Empfang unterschreiben.", "Koly vyizni tekhniky mozhut poprosyty avansovyi zvit?", "Теаm lеаds must аrсhivе the ассеss ticket аt thе frоnt dеsk.",
    ]
    found = detect(spark, model, texts)
    assert [r["lang"] for r in found] == ["en", "uk", "ru", "pl", "de", "uk", "en"]
    assert all(0 <= r["confidence"] <= 1 and r["languages"] == [r["lang"]] for r in found)


def test_mixed_and_quoted(spark, model):
    en = "Team leads must archive the access ticket at the front desk. "
    uk = "Працівники складу повинні перевірити запит на доступ у перший день."
    a, b, c = detect(spark, model, [en + uk, en + "They call it «Працівники складу повинні перевірити запит» there.", en + "(" + uk + ")"])
    assert sorted(a["languages"]) == ["en", "uk"] and [s["lang"] for s in a["segments"]] == ["en", "uk"]
    assert (en + uk)[a["segments"][1]["start"] : a["segments"][1]["stop"]].strip() == uk
    assert b["languages"] == ["en"] and c["languages"] == ["en"]


def test_edges(spark, model):
    found = detect(spark, model, [None, "", " ​", "OPS-123 https://a.example/b 77", "[Leave rules 2023]", "When can recruiters ask for the plan? " * 30_000])
    assert [r["lang"] for r in found] == [None] * 5 + ["en"] and all(r["confidence"] == 0 and r["segments"] == [] for r in found[:5])
    assert detect(spark, model, []) == []


def test_labels(spark):
    rows = [("EN", "en"), ("uk-UA", "uk"), ("ua", "uk"), ("rus", "ru"), ("Polish", "pl"), ("de_AT", "de"), (" ", None), ("??", None), (None, None), ("fr", None)]
    df = spark.createDataFrame(rows, "l string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", language.label_language(df.l)).collect())


def test_held_out_accuracy(spark, model):
    """Against the delivered labels of rows, most of which are right."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", language.label_language(F.col("lang")).alias("label"), "text").where("label is not null and length(text) > 200")
    found = language.detect(docs, ["doc_id", "label"], "text", model)
    assert found.agg(F.avg((F.col("label") == F.col("lang")).cast("int"))).first()[0] > 0.85


def test_sample_holds_rare_languages(spark):
    rows = [(f"e{i:04d}", f"text {i}", "en") for i in range(400)] + [(f"d{i}", f"Satz {i}", "de") for i in range(8)]
    texts, langs = language.sample(spark.createDataFrame(rows, "k string, t string, l string"), "k", "t", "l", rows=40, least=5)
    assert len(set(texts)) == len(texts) and langs.count("de") >= 5 and langs.count("en") >= 32 and len(texts) <= 45
