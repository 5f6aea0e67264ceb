import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators import cache
from quillspark.plans import ask, ingest

NOW = dt.datetime(2024, 1, 1)


def test_cache(spark):
    empty = spark.createDataFrame([], "key string, value string, expires_at timestamp")
    k = lambda q: cache.key(F.col(q), F.lit("wide"))
    rows = spark.createDataFrame([(" How  ARE you ", "a", False), ("how are you", "b", False), ("other", "c", False), ("how are you", "d", True)], "q string, n string, bypass boolean").withColumn("key", k("q"))
    stored = cache.put(empty, rows.where("n = 'a'").select("key", F.lit("fine").alias("value")), NOW)
    later = NOW + dt.timedelta(seconds=100)
    assert {r["n"]: r["value"] for r in cache.get(rows, stored, later).collect()} == {"a": "fine", "b": "fine", "c": None, "d": None}
    assert cache.get(rows, stored, NOW + dt.timedelta(seconds=200)).where("value is not null").count() == 0
    assert cache.invalidate(stored, stored.first()["key"][:5]).count() == 0


def test_ingest(spark):
    text = "# Sick leave\n" + "Team leads must archive the access ticket at the front desk. " * 10
    files = spark.createDataFrame([("docs/My File.md", text, text), ("b.md", None, None), ("c.md", "", "")], "name string, raw string, text string")
    found = ingest.ingest(files, "parent_child").collect()
    assert {r["level"] for r in found} == {0, 1} and all((r["embedding"] is None) == (r["level"] == 0) for r in found)
    assert all(r["file_id"] == "docs_my_file" for r in found) and {"sick", "leave"} <= set(found[0]["context_keywords"])
    for strategy in ("simple", "semantic"):
        rows = ingest.ingest(files, strategy).collect()
        assert rows and all(r["level"] is None and len(r["embedding"]) == 64 and r["text_length"] >= 80 for r in rows)


def chunks(spark):
    rows = [(f"c{i}", f"{w} " * 20, None, [w], [float(i == j) for j in range(3)], None, 100) for i, w in enumerate(["apple", "berry", "cherry"])] + [("p", "apple " * 20, None, None, None, 0, 100)]
    df = spark.createDataFrame(rows, "id string, text string, parent_text string, context_keywords array<string>, embedding array<double>, level int, text_length int")
    return df.unionByName(df.limit(1))


def test_retrieve_and_adapt(spark):
    variants = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0], ["apple"]), (1, 1, [1.0, 0.1, 0.0], ["cherry"]), (2, 0, None, ["nothing"])], "query_id int, variant int, vector array<double>, keywords array<string>")
    found = ask.retrieve(chunks(spark), variants, 2, size=3).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in found} == {1} and found[0]["id"] in ("c0", "c2") and len(found) == 2
    asked = variants.where("variant = 0").drop("variant")
    got = ask.adaptive(chunks(spark), asked, 3, trust=0.3, size=3).where("query_id = 1")
    assert {(r["id"], r["hybrid"]) for r in got.collect()} == {("c0", False), ("c1", False), ("c2", False)}
    assert all(r["hybrid"] for r in ask.adaptive(chunks(spark), asked, 3, trust=0.9, size=3).collect())
    texts = ask.contexts(found and ask.retrieve(chunks(spark), variants, 2, size=3), chunks(spark)).first()["context"]
    assert len(texts) == 2


def test_prompt(spark):
    df = spark.createDataFrame([("why?", ["a", "b"], None, "f"), ("x", [], "h", "")], "q string, c array<string>, h string, f string")
    assert [r[0] for r in df.select(ask.prompt(F.col("q"), F.col("c"), F.col("h"), F.col("f"))).collect()] == ["Context:\na\n\nb\n\nFacts:\nf\n\nQuestion:\nwhy?", "Earlier:\nh\n\nQuestion:\nx"]
