from pyspark.sql import functions as F

from quillspark.llm import readability


def test_bands_agree_with_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "reading_labels"))
    labels = labels.where("band is not null")
    fit, held = labels.where(F.col("doc_id") % 2 == 0), labels.where(F.col("doc_id") % 2 == 1)
    found = readability.levels(docs.select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id"), "doc_id", "text", fit)
    right = found.select("doc_id", F.col("band").alias("b")).join(held, "doc_id").agg(F.avg((F.col("b") == F.col("band")).cast("int"))).first()[0]
    assert right > 0.9


def test_running_text(spark):
    text = "# Title here\nA plain line title\n\nThis is one. And two!\n- item one\n| a | b |\n```\ncode. code.\n```\nSee https://x.example/y. Done"
    got = spark.createDataFrame([(text,)], "t string").select(readability.running_text(F.col("t"))).first()[0]
    assert got.split() == ["this", "is", "one.", "and", "two!"]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "# Title only"), (4, "- item\n- item"), (5, "Go to the car. Take the box."), (5, "Go to the car. Take the box."), (6, "The epistemological determination legitimises infrastructural reconfiguration. " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS words", "1 AS grade")
    labels = spark.createDataFrame([(5, "easy"), (5, None)], "doc_id bigint, band string")
    found = readability.levels(docs, "doc_id", "text", labels).collect()
    assert sorted(r["doc_id"] for r in found) == [5, 5, 6]
    assert readability.levels(docs.limit(0), "doc_id", "text", labels.limit(0)).count() == 0


def test_syllables_by_hyphenation_rules():
    words = {"table": 2, "stated": 2, "used": 1, "mutual": 3, "boxes": 2, "makes": 1, "station": 2, "video": 3, "radio": 3, "the": 1, "little": 2, "wanted": 2, "places": 2, "queue": 1}
    for w, n in words.items():
        assert readability.measure([f"the {w} is in the box."])["syllables"][0] == n + 5, w
    # the hiatus of its own language only
    got = readability.measure(["das video ist im radio und die liebe.", "oni są na biurze i nie mają geografii.", "це є її мрія.", None, "", "no end"])
    assert got["syllables"].tolist()[:3] == [1 + 3 + 1 + 1 + 3 + 1 + 1 + 2, 2 + 1 + 1 + 2 + 1 + 1 + 2 + 4, 1 + 1 + 2 + 2] and got["sentences"].tolist() == [1, 1, 1, 0, 0, 0]


def test_sentences():
    assert readability.measure(['one. two! "three?" four... five (six.) seven.', "3.5 per cent", "a.b c.\nd…"])["sentences"].tolist() == [6, 0, 2]


def test_a_text_has_one_grade_in_any_corpus(spark):
    text = "The committee must confirm the plan. Staff can then order the forms from the front desk."
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    alone = spark.createDataFrame([(-1, text)], "doc_id bigint, text string")
    grade = lambda df: readability.grades(df, "doc_id", "text").where("doc_id = -1").select("grade", "word_grade").first()
    assert grade(alone) == grade(real.unionByName(alone))


def test_sentence_length_counts_for_the_grade_alone(spark):
    words = "The team will confirm the yearly holiday plan before the end of the week"
    rows = [(1, f"{words}. " * 6), (2, " and ".join([words] * 6) + ".")]
    short, long = readability.grades(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").orderBy("doc_id").collect()
    assert long["grade"] > short["grade"] + 8 and abs(long["word_grade"] - short["word_grade"]) < 2


def test_limits():
    assert readability.fit_limits([1, 2, 10, 11, 30], ["easy", "easy", "standard", "standard", "hard"]) == (6.0, 20.5)
    assert readability.fit_limits([], []) == readability.DEFAULT_LIMITS
