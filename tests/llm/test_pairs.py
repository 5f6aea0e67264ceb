import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import pairs, queries
from quillspark.llm.words import Words, hash_of


def planted(spark, rows, sf="/root/testdata/sf0.01"):
    base = spark.read.parquet(f"{sf}/turns.parquet").select("id", "query", "answer")
    extra = spark.createDataFrame([(f"x{i}", q, a) for i, (q, a, _) in enumerate(rows)], "id string, query string, answer string")
    found = {r["id"]: r["defect"] for r in pairs.defects(pairs.label(base.unionByName(extra), queries.language_model(spark, sf))).groupBy("id").agg({"order": "min"}).selectExpr("id", "`min(order)` AS o").selectExpr("id", "o AS defect").collect()}
    return [pairs.DEFECTS[found[f"x{i}"]] if f"x{i}" in found else None for i in range(len(rows))]


GOOD = "Team leads must archive the access ticket at the front desk. The form HR-12 covers 14 cases and was last changed on 2024-01-02 so nobody waits at the door."
ROWS = [
    ("How do I get the sick note?", None, "empty"), ("How do I get the sick note?", " ​", "empty"), ("How do I get the sick note?", "N/A", "empty"), ("How do I get the sick note?", "...", "empty"),
    ("How do I get the sick note?", GOOD[:97], "truncated"), ("How do I get the sick note?", GOOD + "\n- the plan\n-", "truncated"), ("How do I get the sick note?", GOOD + "\n```\nrows = lo", "truncated"),
    ("How do I get the sick note?", "I cannot answer this question.", "refusal"), ("Jak dostać plan?", "Niestety nie wolno mi omawiać tego tematu. Miłego dnia.", "refusal"),
    ("Which file explains the travel report?", "> Which file explains the travel report", "copy"), ("Which file explains the travel report?", "Re: WHICH FILE EXPLAINS THE TRAVEL REPORT?", "copy"),
    ("Which file explains the travel report?", "Працівники складу повинні перевірити запит на доступ у перший день.", "other_language"),
    ("How do I get the sick note?", GOOD, None), ("How do I get the sick note?", "Yes.", None), ("Which room?", "Room 101", None), ("How do I get the sick note?", "I am not able to open the file myself, but the rule is clear. " + GOOD, None),
    ("Which file explains the travel report?", "Which file explains the travel report? " + GOOD, None), (None, GOOD, None),
]


LONG = "Which of the forms that the branch office in the north sent to the archive last spring must the new team leads sign again before " * 5 + "the end of the year?"
PROBES = [
    (LONG, LONG.replace("north", "south").replace("spring", "autumn"), "copy"), ("Which file explains the travel report?", "\u200b" * 200 + "Which file explains the travel report?" + "\u200b" * 200, "copy"),
    ("Which file explains the travel report?", "**" * 150 + "Which file explains the travel report?", "copy"), ("Where is the English course list?", "Працівники складу повинні перевірити запит на доступ у перший день.", "other_language"),
    ("Where is the English course list, in German?", "Працівники складу повинні перевірити запит на доступ у перший день.", "other_language"), ("Where is the course list? Answer in Ukrainian.", "Працівники складу повинні перевірити запит на доступ у перший день.", None),
    (LONG, GOOD, None), ("What does the plan say?", "Nothing changed.", None), ("What does the plan say?", "Only on Mondays", None), ("What does the plan say?", "**Kein Kommentar.**", "refusal"),
]
#: Refusals that no pattern of pairs.DECLINE holds.
UNSEEN = [
    ("Ile dni potrzebuje zespół na rozliczenie wydatków?", "Wolę nie mówić o tym. Miłego dnia."), ("How do I get the sick note?", "Sorry, as an assistant I am not at liberty to give such details. Please ask someone else."),
    ("How do I get the sick note?", "My guidelines do not let me say that. Is there anything else?"), ("Як отримати лікарняний лист?", "На жаль, я не маю змоги про це говорити. Чи є ще щось?"), ("Как получить больничный лист?", "К сожалению, мне нельзя говорить об этом. Обратитесь к кому-нибудь другому."),
]


def test_planted(spark):
    assert planted(spark, ROWS + PROBES) == [d for _, _, d in ROWS + PROBES]


def test_unseen_refusals(spark):
    """The odds of words find refusals that no pattern holds."""
    rows = spark.createDataFrame(UNSEEN, "query string, answer string")
    assert rows.where(F.array_contains(pairs._kinds(pairs._low("answer")), 1)).count() == 0
    assert planted(spark, [(q, a, "refusal") for q, a in UNSEEN]).count("refusal") >= 4


def spoiled(spark):
    """Turns of the smaller table with planted defects (id, want), by rule and hash: what they were before is good for the most part."""
    base = spark.read.parquet("/root/testdata/sf0.01/turns.parquet").dropDuplicates(["id"]).where("length(answer) > 120 and length(query) > 20 and query is not null").select("id", "query", "answer", "lang")
    h = F.pmod(F.xxhash64("id"), F.lit(12))
    words = F.split("answer", " ")
    broken = F.array_join(F.slice(words, 1, F.greatest(F.lit(6), F.size(words) - 4)), " ")
    english = F.col("query").rlike(r"\b(the|who|what|which|how)\b")  # labels may be wrong
    other = base.where("lang = 'uk' and answer rlike '[іїє]'").select(F.col("answer").alias("o")).limit(1).first()["o"]
    rules = [(0, F.lit(""), "empty"), (1, F.concat(F.lit("Re: "), F.upper("query")), "copy"), (2, F.concat(F.regexp_replace("query", r"^\S+ ", ""), F.lit("!")), "copy"), (3, broken, "truncated"), (4, F.concat(broken, F.lit("\n```\nrows = x")), "truncated"), (5, F.lit("I cannot answer this question. Have a nice day."), "refusal")]
    answer, want = F.col("answer"), F.lit("none")
    for i, made, name in rules:
        here = (h == i) & (F.lit(name != "refusal") | english)
        answer, want = F.when(here, made).otherwise(answer), F.when(here, name).otherwise(want)
    answer, want = F.when((h == 6) & english, other).otherwise(answer), F.when((h == 6) & english, "other_language").otherwise(want)
    return base.select("id", "query", answer.alias("answer"), want.alias("want"))


def test_cutoffs_are_validated(spark):
    """On planted defects, each cutoff does about as well on one half of the rows as the best one of the other half."""
    rows = spoiled(spark).cache()
    found = pairs.label(rows, queries.language_model(spark, "/root/testdata/sf0.01")).join(rows.select("id", "want"), "id").collect()
    for d in pairs.DEFECTS:
        def f1(part, cut, d=d):
            hit = sum(r[d] > cut and r["want"] == d for r in part)
            # rows that were defective before count for nothing
            wrong = sum(r[d] > cut and r["want"] not in (d, "none") and not (d == "truncated" and r["want"] == "copy") for r in part)
            return 2 * hit / max(1, 2 * hit + wrong + sum(r[d] <= cut and r["want"] == d for r in part))

        one, two = found[::2], found[1::2]
        best = max((0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95), key=lambda c: (f1(one, c), -abs(c - 0.5)))
        assert f1(two, pairs.CUTOFFS[d]) >= f1(two, best) - 0.02 and f1(two, pairs.CUTOFFS[d]) >= 0.9


def test_posterior_differs_from_majority():
    """Functions that err often count for less than a majority vote gives them."""
    patterns = {(0, -1, 0, 0): 21628, (0, 0, 0, 0): 1059, (-1, -1, 1, 0): 594, (-1, -1, 0, 0): 403, (1, -1, 1, 1): 264, (1, -1, -1, 1): 108, (1, 1, -1, 1): 79, (1, -1, 0, 1): 47, (1, 1, 0, 1): 22, (1, -1, 0, -1): 7}
    post = pairs.fit_labels(patterns)
    assert post[-1, -1, 1, 0] < 0.2 and post[1, -1, 0, 1] > 0.8  # both are ties or nearly so


def test_edges(spark):
    model = queries.language_model(spark, "/root/testdata/sf0.001")
    none = spark.createDataFrame([], "id string, query string, answer string")
    assert pairs.defects(pairs.label(none, model)).count() == 0
    rows = [("a", "q?", None), ("a", "q?", None), (None, "q", "a"), ("b", None, None), ("c", "q " * 50_000, "word " * 100_000)]
    df = spark.createDataFrame(rows, "id string, query string, answer string").selectExpr("*", "'x' AS votes", "1 AS empty")
    found = {r["id"] for r in pairs.defects(pairs.label(df, model)).where("defect = 'empty'").collect()}
    assert {"a", "b"} <= found


def test_label_model():
    patterns = {(1, 1, 1): 50, (0, 0, 0): 900, (1, 0, -1): 20, (0, 1, -1): 10, (-1, -1, -1): 5}
    post = pairs.fit_labels(patterns)
    assert post[(1, 1, 1)] > 0.9 > 0.1 > post[(0, 0, 0)] and pairs.fit_labels({}) == {}


def test_statistics_are_of_all_turns(spark):
    """Of 20,000 turns, each word that a single one has is counted, and a text that breaks off isn't its own evidence."""
    letters = "abcdefghijklmnopqrst"
    rare = [f"zu{a}{b}e" for a in letters for b in "klm"]
    i = F.col("id").cast("int")
    word = F.get(F.array(*map(F.lit, rare)), (i / 400).cast("int") % 60)
    answer = F.when(i % 400 == 0, F.concat(F.lit("It ends with "), word, F.lit("."))).when(i % 400 == 1, F.concat(F.lit("It breaks off in half"), word)).when(i % 400 == 2, F.lit("I cannot answer this question.")).otherwise("It is fine now.")
    rows = spark.range(20_000).select(F.col("id").cast("string"), F.lit("What is it?").alias("query"), answer.alias("answer")).withColumn("_kinds", pairs._kinds(pairs._low("answer")))
    stats = pairs.statistics(rows)
    whole, cut = [f"It ends with {w}" for w in rare[:50]], [f"It breaks off in half{w}" for w in rare[:50]]
    assert stats.unfinished(Words(whole), whole).tolist() == [0] * 50
    assert stats.unfinished(Words(cut), cut).tolist() == [1] * 50
    assert stats.declining(Words(["It is fine now.", None])).tolist() == [0, -1] and stats.score(Words(["I cannot answer this question."]))[0] > stats.low


def test_word_counts():
    counts = lambda w: dict(zip(pairs.COUNTS, n[list(h).index(hash_of(w))]))
    h, n = pairs.word_counts(["so?", None, ""], ["So it is. It", "it was so", None], np.array([0, 3, 1]), np.array([True, False, True]))
    assert {k: v for k, v in counts("so").items() if v} == {"final": 1, "inner": 1, "yes0": 1, "no3": 1}  # the last one breaks off
    assert {k: v for k, v in counts("it").items() if v} == {"inner": 2, "yes0": 1, "no3": 1} and {k: v for k, v in counts("is").items() if v} == {"final": 1, "yes0": 1}
    h, n = pairs.word_counts([], [], np.zeros(0, int), np.zeros(0, bool))
    assert len(h) == 0 and n.shape == (0, len(pairs.COUNTS))
    both, sums = pairs._summed(np.array([5, 3, 5], np.uint64), np.array([[1, 0], [2, 2], [3, 4]]))
    assert both.tolist() == [3, 5] and sums.tolist() == [[2, 2], [4, 4]]


def test_limits():
    low, high = pairs.limits({2.0: 500, 4.0: 500}, {-3.0: 9000, -1.0: 9000, 1.0: 2})
    assert low < high and 1 < (low + high) / 2 <= 2 and abs(high - low - 0.2 * (3.0 - -1.0)) < 1e-9
    assert pairs.limits({}, {1.0: 3}) == (-np.inf, np.inf)
