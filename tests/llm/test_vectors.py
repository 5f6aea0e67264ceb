import numpy as np
import pytest

from quillspark.llm import vectors


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "id string, v array<float>")
    return df.selectExpr("*", "'x' AS shard", "1 AS part", "2.0 AS cosine") if extra else df


def brute(base, queries, k):
    out = {}
    for q, v in queries.items():
        v = np.array(v) / np.linalg.norm(v)
        scored = sorted(((-float(np.dot(v, np.array(x) / np.linalg.norm(x))), i) for i, x in base.items()))
        out[q] = [i for _, i in scored[:k]]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 8))
    base = {f"b{i:04d}": (centers[i % 40] + 0.2 * rng.normal(size=8)).tolist() for i in range(800)}
    queries = {f"q{i:02d}": (centers[i] + 0.2 * rng.normal(size=8)).tolist() for i in range(30)}
    return base, queries


def run(spark, base, queries, **kw):
    found = vectors.nearest(frame(spark, list(base.items()), True), "id", "v", frame(spark, list(queries.items()), True), "id", "v", k=5, size=8, **kw).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append(r["neighbor_id"])
    return out


def test_factor_one_is_exact(spark, data):
    base, queries = data
    assert run(spark, base, queries, shard_factor=1.0, tree_factor=1.0, max_vantages=16) == brute(base, queries, 5)


def test_relaxed_recall(spark, data):
    base, queries = data
    found, true = run(spark, base, queries, max_vantages=16), brute(base, queries, 5)
    hit = sum(len(set(found[q]) & set(true[q])) for q in true)
    assert hit >= 0.9 * 5 * len(true)


def test_tree_with_small_leaves_is_exact():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:50]
    cosine, place = vectors.VantageTree(x, leaf=20).search(q, 3, np.full(50, 2.0), 1.0)
    true = np.sort(q @ x.T, axis=1)[:, -3:]
    assert np.allclose(np.sort(cosine, axis=1), true, atol=1e-5) and (place >= 0).all()


def test_split_shards(spark, data, monkeypatch):
    monkeypatch.setattr(vectors, "SPLIT_ROWS", 30)
    monkeypatch.setattr(vectors, "SPLIT_QUERIES", 5)
    base, queries = data
    assert run(spark, base, queries, shard_factor=1.0, tree_factor=1.0, max_vantages=4) == brute(base, queries, 5)


def test_dirty_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [0.0, 0.0]), ("e", [nan, 1.0]), ("f", [inf, 1.0]), ("g", [1.0, 1.0, 1.0]), ("h", [1e-30, 2e-30]), (None, [1.0, 0.0]), ("i", [None, 1.0])]
    found = vectors.nearest(frame(spark, rows), "id", "v", frame(spark, rows), "id", "v", k=10, size=2).collect()
    assert sorted((r["id"], r["neighbor_id"]) for r in found) == [("a", "a"), ("a", "h"), ("h", "a"), ("h", "h")]


def test_empty(spark):
    none = frame(spark, [])
    one = frame(spark, [("a", [1.0, 0.0])])
    for base, asked in ((none, one), (one, none), (none, none)):
        assert vectors.nearest(base, "id", "v", asked, "id", "v", k=3, size=2).collect() == []


def test_ties_and_self(spark):
    same = frame(spark, [(f"t{i}", [1.0, 2.0]) for i in range(6)])
    found = vectors.nearest(same, "id", "v", same, "id", "v", k=2, size=2, skip_self=True).collect()
    assert len(found) == 12 and all(r["id"] != r["neighbor_id"] for r in found)


def test_recall_of_rows_among_themselves(spark, monkeypatch):
    """Rows within clusters and rows far from all others; the bound of the latter is wide."""
    monkeypatch.setattr(vectors, "SPLIT_ROWS", 700)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(60, 96))
    x = np.concatenate([centers[rng.integers(0, 60, 2000)] + 0.45 * rng.normal(size=(2000, 96)), rng.normal(size=(2000, 96))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = frame(spark, [(f"t{i:04d}", r.tolist()) for i, r in enumerate(x)])
    found = vectors.nearest(rows, "id", "v", rows, "id", "v", k=10, size=96, skip_self=True).collect()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :10]
    hits = np.zeros(len(x))
    for r in found:
        hits[int(r["id"][1:])] += int(r["neighbor_id"][1:]) in true[int(r["id"][1:])]
    assert len(found) == 10 * len(x) and hits.mean() >= 9.7


def test_groups_cover_all_shards():
    x = np.random.default_rng(4).normal(size=(50, 8)).astype(np.float32)
    sizes = np.full(50, 10)
    sizes[7] = 900
    group = vectors.grouped(x, sizes, 100)
    rows = np.bincount(group, sizes)
    assert rows.sum() == sizes.sum() and (rows > 0).all() and all(n <= 100 or (group == g).sum() == 1 for g, n in enumerate(rows))


@pytest.mark.parametrize("asked,vector,own", [("turns", "embedding", True), ("vector_queries", "vector", False)])
def test_recall_on_real_vectors(spark, asked, vector, own):
    """Against brute force over all rows, for both p1 queries."""
    d, key = "/root/testdata/sf0.01", "id" if own else "query_id"
    base, queries = spark.read.parquet(f"{d}/turns.parquet"), spark.read.parquet(f"{d}/{asked}.parquet")
    found = {}
    for r in vectors.nearest(base, "id", "embedding", queries, key, vector, out_id="turn_id", skip_self=own, half=own).collect():
        found.setdefault(r[key], set()).add(r["turn_id"])

    def unit(df, k, v):
        rows = dict(df.where(vectors.usable(v, 96)).select(k, v).collect())
        x = np.array(list(rows.values()), float)
        return list(rows), x / np.linalg.norm(x, axis=1, keepdims=True)

    ids, x = unit(base, "id", "embedding")
    qids, q = unit(queries, key, vector)
    hits = total = 0
    for i, s in zip(qids, q @ x.T):
        best = [ids[j] for j in np.argsort(-s)[:11] if not (own and ids[j] == i)][:10]
        hits, total = hits + len(found[i] & set(best)), total + len(best)
    assert hits / total >= 0.97
