from quillspark.llm import canon

GROUPS = [
    ["wdrożenie", "wdrożеniе", "w⁠dr᠎ożenie", "wdrożenie", "ｗｄｒożｅｎｉｅ"],
    ["поїздка", "поïздка", "поӥздка".replace("и", "і")],
    ["first-aid file", "first‑aid file", "ﬁrst-aid ﬁle"],
    ["CO₂"], ["CO2"], ["Office"], ["office"], ["cafe"], ["café", "café"],
]


def test_classes(spark):
    rows = [("k", v, g, i == 0) for g, group in enumerate(GROUPS) for i, v in enumerate(group)]
    df = spark.createDataFrame(rows, "kind string, value string, g int, ref boolean")
    found = canon.canonical(df, "kind", "value", "ref").collect()
    assert {r["value"]: r["canonical"] for r in found} == {v: group[0] for group in GROUPS for v in group}


def test_edges(spark):
    rows = [("k", None), ("k", ""), ("k", "​"), ("k", "b"), ("k", "b"), ("k", "ƅ"), (None, "b"), ("k", "x" * 200_000)]
    df = spark.createDataFrame(rows, "kind string, value string").selectExpr("*", "1 AS n", "2 AS form")
    found = [(r["kind"], r["value"], r["canonical"]) for r in canon.canonical(df, "kind", "value").collect()]
    assert len(found) == len(rows)
    assert ("k", None, None) in found and ("k", "​", "") in found and ("k", "ƅ", "ƅ") in found
    assert canon.canonical(df.limit(0), "kind", "value").count() == 0


def test_most_frequent_spelling_wins(spark):
    df = spark.createDataFrame([("k", "оffice"), ("k", "оffice"), ("k", "office")], "kind string, value string")
    assert {r["canonical"] for r in canon.canonical(df, "kind", "value").collect()} == {"оffice"}
