"""What is shuffled grows with chunks and queries, not with their product."""

from quillspark.operators import links, retrieval
from quillspark.plans import ask

CHUNKS, QUERIES = 600, 400


def shuffled(spark, run):
    """Records that the stages of run shuffled, and what it gave."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (lambda q: [q.apply(i) for i in range(q.size())])(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()))}
    before = stages()
    rows = run().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k not in before), rows


def tables(spark):
    rows = [(f"c{i:04d}", "alpha beta " + f"word{i % 7} " * 30, [1.0, float(i), 0.0]) for i in range(CHUNKS)]
    chunks = spark.createDataFrame(rows, "id string, text string, embedding array<float>").selectExpr("*", "'' AS parent_text", "array() :: array<string> AS context_keywords", "1 AS level", "length(text) AS text_length")
    asked = spark.createDataFrame([(i, [1.0, float(i), 1.0], ["alpha"]) for i in range(QUERIES)], "query_id int, vector array<float>, keywords array<string>")
    return chunks, asked


def test_multi_query(spark):
    chunks, asked = tables(spark)
    n, rows = shuffled(spark, lambda: ask.retrieve(chunks, asked.selectExpr("query_id", "0 AS variant", "vector", "keywords"), 2, size=3))
    assert len(rows) == 2 * QUERIES and n < CHUNKS * QUERIES / 4


def test_links(spark):
    rows = [(f"l{i:04d}", f"https://x.org/{i}", "alpha", "beta", "gamma", ["alpha"], i) for i in range(CHUNKS)]
    stored = spark.createDataFrame(rows, "id string, url string, label string, context string, source_file string, keywords array<string>, created_at int")
    asked = spark.createDataFrame([(i, ["Alpha"]) for i in range(QUERIES)] + [(-1, [None, ""]), (-2, None)], "query_id int, keywords array<string>")
    n, rows = shuffled(spark, lambda: links.find_by_keywords(stored, asked, 2))
    assert len(rows) == 2 * QUERIES and {r["relevance"] for r in rows} == {3} and n < CHUNKS * QUERIES / 4


def test_entity(spark):
    chunks, asked = tables(spark)
    n, rows = shuffled(spark, lambda: retrieval.hybrid_search(chunks, asked, 2, "entity", size=3))
    assert len(rows) == 2 * QUERIES and n < CHUNKS * QUERIES / 4


def test_wide(spark):
    chunks, asked = tables(spark)
    n, rows = shuffled(spark, lambda: retrieval.hybrid_search(chunks, asked, 2, "wide", size=3, phrases={"alpha": ["beta"]}))
    assert len(rows) == 2 * QUERIES and n < CHUNKS * QUERIES / 4


def test_approximate(spark):
    chunks, asked = tables(spark)
    n, rows = shuffled(spark, lambda: retrieval.nearest_approximate(chunks, "id", "embedding", asked, "query_id", "vector", 2, 3, probes=8, cells=16))
    assert len(rows) == 2 * QUERIES and n < 8 * QUERIES  # queries aren't sent to each of their cells


def test_adaptive(spark):
    chunks, asked = tables(spark)
    n, rows = shuffled(spark, lambda: ask.adaptive(chunks, asked, 2, trust=2.0, size=3))
    assert len(rows) == 2 * QUERIES and all(r["hybrid"] for r in rows) and n < CHUNKS * QUERIES / 4


def test_adaptive_searches_once(spark, monkeypatch):
    """One reading of the vectors serves sure and unsure questions, and of questions for names no texts are shuffled."""
    chunks, asked = tables(spark)
    long = "array_join(transform(sequence(1, 60), x -> sha2(concat(id, x), 256)), ' ')"
    chunks = chunks.selectExpr("id", f"concat('alpha beta ', {long}) AS text", "embedding", "parent_text", "context_keywords", "level", "text_length").cache()
    names = asked.selectExpr("query_id", "vector", "array(IF(query_id % 2 = 0, 'Alpha', 'omega')) AS keywords", "query_id % 4 < 2 AS entity")
    store, calls = retrieval.stored, []
    monkeypatch.setattr(retrieval, "stored", lambda df: calls.append(1) or store(df))
    size = lambda: sum(s["bytes"] for s in stages(spark))
    before = size()
    rows = ask.adaptive(chunks, names, 2, trust=-1.0, size=3, entity="entity").collect()
    assert len(rows) == 2 * QUERIES and {r["query_id"] for r in rows if r["hybrid"]} == {i for i in range(QUERIES) if i % 4 == 1}
    assert len(calls) == 1 and size() - before < chunks.selectExpr("sum(length(text))").first()[0] / 4


def stages(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return [{"bytes": found.apply(i).shuffleWriteBytes()} for i in range(found.size())]


def test_adaptive_blank_keywords(spark):
    """A blank keyword is held by any text that holds its blanks."""
    chunks, _ = tables(spark)
    asked = spark.createDataFrame([(1, [1.0, 5.0, 0.0], [""], True), (2, [1.0, 5.0, 0.0], ["   "], True), (3, [1.0, 5.0, 0.0], ["   ", "BETA"], True), (4, None, ["alpha"], True), (5, [1.0, 5.0, 0.0], [], True)], "query_id int, vector array<float>, keywords array<string>, entity boolean")
    rows = ask.adaptive(chunks, asked, 2, trust=0.1, size=3, entity="entity").collect()
    assert {r["query_id"]: r["hybrid"] for r in rows} == {1: False, 2: True, 3: False, 4: True, 5: False}
