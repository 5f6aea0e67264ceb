import itertools
import random
import re

import numpy as np
import pytest

from quillspark.llm import neardup


def shingles(text, width):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, t, min_words=20):
    sets = {k: (b, shingles(x, width)) for k, b, x in rows if x and len(re.findall(r"[^\W_]+", x)) >= min_words}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= t * len(sets[a][1] | sets[b][1])}


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[2].split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(vocabulary)}"
        else:
            words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(15, 60))]
        rows.append((f"k{i:04d}", i % 2, " ".join(words)))
    return rows


def expand(links, members):
    by = {}
    for r in members.collect():
        by.setdefault(r["cls"], set()).add(r["key"])
    pairs = {tuple(sorted(p)) for m in by.values() for p in itertools.combinations(m, 2)}
    for r in links.collect():
        pairs |= {tuple(sorted((x, y))) for x in by[r["a"]] for y in by[r["b"]]}
    return pairs


@pytest.mark.parametrize("vocabulary,boundaries,small,block,split", [(5000, None, 48, 128, 8192), (30, [2], 48, 0, 8192), (30, [2], 3, 0, 8192), (12, [1], 0, 0, 8192), (30, [2], 3, 1000, 8192), (30, [2], 48, 0, 5), (12, [1], 0, 0, 7), (30, [2], 3, 1000, 20)])
def test_equals_brute_force(spark, monkeypatch, vocabulary, boundaries, small, block, split):
    monkeypatch.setattr(neardup, "SPLIT", split)
    if boundaries:
        monkeypatch.setattr(neardup, "BOUNDARIES", boundaries)
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "SMALL_BLOCK", block)
    from pyspark.sql import functions as F

    rows = corpus(5, 220, vocabulary)
    df = spark.createDataFrame(rows, "key string, block int, text string").withColumn("cls", F.lit(1))
    links, members = neardup.near_duplicates(df, "key", "text", F.col("block"), width=2, t=0.6)
    assert expand(links, members) == brute(rows, 2, 0.6)


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [("a", text), ("b", text.upper() + " !"), ("b", text), ("c", None), ("d", ""), ("e", "too short"), ("f", text + " " + " ".join(f"v{i}" for i in range(50_000)))]
    df = spark.createDataFrame(rows, "key string, text string")
    links, members = neardup.near_duplicates(df, "key", "text")
    assert expand(links, members) == {("a", "b")} and {r["key"] for r in members.collect()} == {"a", "b", "f"}
    links, members = neardup.near_duplicates(df.limit(0), "key", "text")
    assert links.count() == 0 and members.count() == 0


def test_one_signature_in_many_sets(spark, monkeypatch):
    """20,000 sets share one pair of heavy shingles; it is split into blocks, and no pair is lost."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "SPLIT", 1000)
    rng = random.Random(3)
    # the same beginning, sizes from 20 to some 1,000 words; a hundred near-copies
    rows = [(f"k{i:05d}", " ".join(["common", "words", "come", "first"] + [f"v{rng.randrange(10**9)}" for _ in range(20 + i % 60 * (1 + i % 7))])) for i in range(20_000)]
    rows += [(f"z{i:03d}", rows[i * 40][1] + " more") for i in range(100)]
    hot, blocks = neardup._splits(np.bincount([7] * 20_100, minlength=2**10))
    assert list(hot) == [7] and blocks[0] == 21
    df = spark.createDataFrame(rows, "key string, text string").repartition(8)
    links, members = neardup.near_duplicates(df, "key", "text", width=2, t=0.9)
    assert members.count() == 20_100
    found = expand(links, members.join(links.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls"))
    assert {(f"k{i * 40:05d}", f"z{i:03d}") for i in range(100) if len(rows[i * 40][1].split()) >= 30} <= found


def test_members_of_a_hot_class(spark):
    members = spark.createDataFrame([(f"k{i}", 1 if i < 30 else i) for i in range(40)], "key string, cls bigint")
    spread, hot = neardup.spread_members(members, 7)
    assert hot.collect()[0]["parts"] == 5 and spread.count() == 40 and spread.where("cls = 1").select("salt").distinct().count() > 1
    assert neardup.spread_members(members, 50) == (members, None)
    pairs = spark.createDataFrame([(1, 31), (32, 33)], "a bigint, b bigint")
    found = neardup.with_members(neardup.with_members(pairs, "a", spread, hot, "ka"), "b", spread, hot, "kb").select("ka", "kb")
    plain = neardup.with_members(pairs, "a", members, None, "ka")
    assert plain.count() == 31
    assert sorted(map(tuple, found.collect())) == sorted([(f"k{i}", "k31") for i in range(30)] + [("k32", "k33")])
