import random

from quillspark.llm import splitting

SCHEMA = "id string, text string, lim int, lap int, piece string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = {}
    for r in splitting.pieces(df, "text", "lim", "lap").collect():
        out.setdefault(r["id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["piece_no"]) for k, v in out.items()}


def test_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = "".join(rng.choice(["word ", "слово ", "end. ", "\n", "\n\n", "😀", "é́", "x" * 70, "- item\n"]) for _ in range(rng.randint(1, 120)))
        limit = rng.choice([1, 5, 20, 50, 200])
        rows.append((f"t{i}", text, limit, rng.choice([0, 3, limit // 2, limit - 1])))
    found = run(spark, rows)
    for key, text, limit, lap in rows:
        if len(text) <= limit:
            assert key not in found
            continue
        lap = limit // 2 if lap >= limit else lap
        end = 0
        for n, r in enumerate(found[key]):
            assert r["piece"] == text[r["start_index"] : r["start_index"] + len(r["piece"])] and 0 < len(r["piece"]) <= limit
            assert r["start_index"] == (0 if n == 0 else max(0, end - lap))
            end = r["start_index"] + len(r["piece"])
        assert end == len(text)


def test_boundaries(spark):
    text = "First sentence here. Second one follows.\n\nNew paragraph starts. And ends."
    cut = [r["piece"] for r in run(spark, [("a", text, 50, 0)])["a"]]
    assert cut == ["First sentence here. Second one follows.\n\n", "New paragraph starts. And ends."]


def test_edges(spark):
    assert run(spark, [("n", None, 5, 0), ("e", "", 5, 0), ("s", "abc", 3, 1)]) == {}
    found = run(spark, [("o", "abcdef", 4, 9), ("z", "abc", 0, 0), ("l", "y" * 100_000, 1000, 150)])
    assert [r["piece"] for r in found["z"]] == ["a", "b", "c"] and all(len(r["piece"]) <= 4 for r in found["o"]) and len(found["l"]) == 118


def test_options(spark):
    chunks = spark.createDataFrame([("a", "f", 0, "x" * 50, None), ("b", "f", None, "x" * 50, "y" * 41), ("c", "g", 1, "x" * 5000, None), ("d", None, 1, "x" * 1201, "x" * 4000), ("e", "h", 1, "x" * 5000, None)], "id string, file_id string, level int, text string, parent_text string")
    options = spark.createDataFrame([("f", 40, 60, 5, "2024-01-01"), ("f", 10, 10, 1, "2023-01-01"), ("g", 100, 50, 50, "2024-01-01"), ("h", None, None, None, None)], "file_id string, parent_size int, child_size int, overlap int, updated_at string")
    found = {(r["id"], r["field"]) for r in splitting.oversized(chunks, options).collect()}
    assert found == {("a", "text"), ("b", "parent_text"), ("d", "text"), ("e", "text")}
    assert splitting.oversized(chunks.limit(0), options.limit(0)).count() == 0
