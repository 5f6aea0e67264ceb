import numpy as np

from quillspark.llm import mixing


def test_splitting_tree_is_exact():
    counts = np.array([700, 30, 1, 0, 269])
    out = mixing.split_counts(counts, 7, np.random.default_rng(1))
    assert out.shape == (7, 5) and (out.sum(axis=0) == counts).all() and (out >= 0).all() and np.ptp(out.sum(axis=1)) <= 2


def test_quotas():
    # a capped source falls short, the others keep to their shares of the total
    assert mixing.quotas({"a": 1.0, "b": 1.0, "c": 2.0, "z": 0.0}, {"a": 2}, {"a": 10, "b": 100, "z": 9}, 120) == {"a": 20, "b": 30}
    assert mixing.quotas({"a": 1.0, "b": 3.0}, {}, {"a": 100, "b": 100}, 200) == {"a": 50, "b": 150}
    assert mixing.quotas({"a": 1.0}, {"a": 0}, {"a": 5}, 5) == {} and mixing.quotas({}, {}, {}, 9) == {}


def test_steps_visit_all_blocks():
    for n in (1, 2, 3, 12, 97, 4096):
        assert sorted(i * mixing.step_of(n) % n for i in range(n)) == list(range(n))


def frames(spark, weights):
    docs = [(i, "word " * (1 + i % 7), "big" if i % 3 else "mid") for i in range(600)] + [(1000 + i, "tiny text", "small") for i in range(5)] + [(2000, None, "big"), (2001, "", "big"), (2002, "x", None)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "1 AS block", "2 AS tokens"), spark.createDataFrame(weights, "mix_id string, source string, target_share double, max_repeats int")


WEIGHTS = [("m", "big", 0.5, 1), ("m", "mid", 0.3, None), ("m", "small", 0.2, 3), ("m", "gone", 0.1, 1), ("n", "small", 1.0, 2), ("o", "big", None, 1), (None, "big", 1.0, 1), ("q", "mid", 1.0, None), ("q", "mid", 1.0, None)]


def check(spark, **kw):
    docs, weights = frames(spark, WEIGHTS)
    sized = mixing.sized(docs, "doc_id", "text", "source")
    rows = mixing.mixed(sized, weights, "doc_id", **kw).collect()
    assert {r["doc_id"] for r in rows}.isdisjoint({2000, 2001, 2002})
    keys = [(r["mix_id"], r["doc_id"], r["copy"]) for r in rows]
    assert len(set(keys)) == len(keys) and all(r["copy"] < 3 for r in rows if r["source"] == "small")
    report = {(r["mix_id"], r["source"]): r for r in mixing.shares(sized, weights, "doc_id", **kw).collect()}
    assert all(abs((r["actual_share"] or 0) - (r["reachable_share"] or 0)) < 0.01 for r in report.values())
    return rows, report


def test_mix(spark):
    rows, report = check(spark, shard_tokens=300)
    places = {}
    for r in rows:
        places.setdefault((r["mix_id"], r["shard"]), []).append(r["pos"])
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values()) and len([k for k in places if k[0] == "q"]) >= 5
    assert report["m", "gone"]["chosen_tokens"] == 0 and report["n", "small"]["repeats"] == 2 and report["m", "small"]["repeats"] == 3 and report["m", "small"]["reachable_share"] < report["m", "small"]["target_share"]
    assert report["q", "mid"]["repeats"] > 1 and report["o", "big"]["chosen_tokens"] == 0
    assert len({tuple(sorted(r["doc_id"] for r in rows if r["mix_id"] == "q" and r["shard"] == k)) for _, k in places}) > 3


def test_total_size(spark):
    _, report = check(spark, total=400)
    assert abs(report["m", "big"]["chosen_tokens"] - 400 * 0.5 / 1.1) <= 3 and sum(r["chosen_tokens"] for k, r in report.items() if k[0] == "q") in range(397, 404)


def test_more_shards_than_the_tree_deals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SHARDS", 2)
    monkeypatch.setattr(mixing, "PARTS", 4)
    monkeypatch.setattr(mixing, "LAST_PARTS", 1)
    rows, _ = check(spark, shard_tokens=400)
    sizes = {}
    for r in rows:
        sizes[r["mix_id"], r["shard"]] = sizes.get((r["mix_id"], r["shard"]), 0) + r["tokens"]
    assert len([k for k in sizes if k[0] == "q"]) > 2 and max(sizes.values()) < 800


def test_empty(spark):
    docs, weights = frames(spark, [("m", "big", 1.0, None)])
    for d, w in ((docs.limit(0), weights), (docs, weights.limit(0))):
        sized = mixing.sized(d, "doc_id", "text", "source")
        assert mixing.mixed(sized, w, "doc_id").count() == 0
        mixing.shares(sized, w, "doc_id").collect()


def test_registered_mixes_hold(spark):
    from quillspark.llm import queries

    rows = queries.p9_balance(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 4 and all(r["shares_hold"] and not (r["cap_exceeded"] or r["repeated"] or r["gaps"] or r["oversized"]) for r in rows)
