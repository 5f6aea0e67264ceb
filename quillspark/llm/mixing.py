"""Mixtures of sources with target shares (problem 9).

Sizes are tokens of a public tokenizer. A mixture has a total size (by default all tokens there are); each source's quota is
its target share of that, or as much as its cap of repetitions allows: then the source falls short, nothing
takes its place, and the report says so. Every source is cut by a hash of the document id into blocks of about equal
size, BLOCKS over all sources; only source and block totals reach the driver. A quota is a number of whole passes
over a source's blocks, a random part of its blocks, and documents of a few more blocks in hash order.

The block quotas are parted among output shards by a splitting tree: at each node a multivariate
hypergeometric draw says how many blocks of each source go left, so all shards are random parts of one exact
mixture. A source's passes are numbered block after block in an order permuted for each pass, so a shard's part of them is a range of
numbers, unfolded by the executors. Beyond MAX_SHARDS shards, rows of a shard are dealt to further ones by a hash, so that a shard
never holds much more than the size asked for. Rows are shuffled within their shard only.

Defined results: shares need not sum to one; null, negative and zero shares take nothing. A source
without tokens, or with a cap under one, gives nothing. Texts without tokens are never chosen. A source named twice in a mixture
counts with the sum of shares and the smaller cap.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.session import cut

#: Blocks of all sources together, and of these the shards that the tree deals them to at most (DRAWS blocks each at least).
BLOCKS, MAX_SHARDS, DRAWS = 4096, 1024, 4
#: Blocks that the last documents of a quota come from, their parts, and the parts of which single documents are chosen.
LAST_BLOCKS, PARTS, LAST_PARTS = 8, 1024, 16
SHARD_TOKENS = 4_000_000
SEED = 20


def split_counts(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: how many blocks of each source go to each shard; columns sum to counts."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    n = int(round(counts.sum() * left / shards))
    down = rng.multivariate_hypergeometric(counts, n, method="marginals") if counts.sum() else counts * 0
    return np.vstack([split_counts(down, left, rng), split_counts(counts - down, shards - left, rng)])


def quotas(shares: dict[str, float], caps: dict[str, float], sizes: dict[str, int], total: float) -> dict[str, float]:
    """Tokens that each source gives: its share of the total, at most its cap times its size; sources that give nothing are left out."""
    wanted = {s: w for s, w in shares.items() if w and w > 0}
    every = sum(wanted.values())
    out = {s: min(total * w / every, max(0, caps.get(s, math.inf)) * sizes[s] if s in caps else math.inf) for s, w in wanted.items() if sizes.get(s, 0) > 0}
    return {s: q for s, q in out.items() if q >= 0.5}


def step_of(blocks: int) -> int:
    """A step that visits all blocks of a pass in an order far from their numbers."""
    step = max(1, round(blocks * 0.618))
    while math.gcd(step, blocks) > 1:
        step += 1
    return step


def sized(docs: DataFrame, key: str, text: str, source: str, folder: str = bpe.TOKENIZER_DIR) -> DataFrame:
    """key, source, tokens of the documents that have tokens; written once."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    return cut(bpe.count_tokens(rows, ["key", "source"], "text", folder).where("tokens > 0"))


def wishes(weights: DataFrame) -> dict[str, tuple[dict[str, float], dict[str, float]]]:
    """(share, cap) by source of each mixture. weights is a parameter: as small as a literal."""
    mixes: dict[str, tuple[dict, dict]] = {}
    for r in weights.where("mix_id is not null and source is not null").select("mix_id", "source", "target_share", "max_repeats").orderBy("mix_id", "source", "target_share", "max_repeats").collect():
        shares, caps = mixes.setdefault(r["mix_id"], ({}, {}))
        shares[r["source"]] = shares.get(r["source"], 0.0) + max(0.0, r["target_share"] or 0.0)
        if r["max_repeats"] is not None:
            caps[r["source"]] = min(caps.get(r["source"], math.inf), r["max_repeats"])
    return dict(sorted(mixes.items()))


def plan(docs: DataFrame, weights: DataFrame, total: int | None = None, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(docs of the sources asked for, with block; a row for each drawn block: mix_id, source, block, copy, shard, subs, limit of tokens or null)."""
    spark = docs.sparkSession
    mixes = wishes(weights)
    named = spark.createDataFrame([(s,) for s in sorted({s for shares, _ in mixes.values() for s in shares})], "source string")
    sizes = {r["source"]: r["t"] for r in docs.join(named, "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # as many as weights name
    total = docs.agg(F.sum("tokens")).first()[0] or 0 if total is None else total
    every = max(1.0, sum(sizes.values()) / BLOCKS)
    number = {s: max(1, round(n / every)) for s, n in sizes.items()}
    placed = docs.join(spark.createDataFrame(sorted(number.items()), "source string, n int"), "source")
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "key"), "n").cast("int")).drop("n")
    totals: dict[str, dict[int, int]] = {}
    for r in placed.groupBy("source", "block").agg(F.sum("tokens").alias("t")).collect():  # about BLOCKS rows
        totals.setdefault(r["source"], {})[r["block"]] = r["t"]
    ranges, single = [], []
    for m, (mix, (shares, caps)) in enumerate(mixes.items()):
        rng = np.random.default_rng([SEED, m])
        given = sorted(quotas(shares, caps, sizes, total).items())
        passes, parts = [], []
        for s, quota in given:
            own = totals[s]
            whole = int((quota + 1e-6) // sizes[s])
            rest = quota - whole * sizes[s]
            turn, out, left = rng.permutation(sorted(own)).tolist(), [], []
            for b in turn:
                if own[b] <= rest:
                    out.append((b, whole, None))
                    rest -= own[b]
                else:  # too large for what is left; others may fit
                    left.append(b)
            if rest >= 0.5:  # the last tokens come from documents of a few more blocks
                out += [(b, whole, float(rest)) for b in left[:LAST_BLOCKS]]
            passes.append(whole * number[s])
            parts.append([out[i] for i in rng.permutation(len(out))])
        counts = np.array([*passes, *map(len, parts)], np.int64)
        if not counts.sum():
            continue
        tokens = sum(q for _, q in given)
        shards = int(min(MAX_SHARDS, max(1, math.ceil(tokens / shard_tokens)), max(1, counts.sum() // DRAWS)))
        subs = max(1, math.ceil(tokens / shards / shard_tokens * 0.99))
        dealt = split_counts(counts, shards, rng)
        for i, (s, _) in enumerate(given):
            ends = np.cumsum(dealt[:, i])
            ranges += [(mix, s, int(ends[k] - n), int(n), number[s], step_of(number[s]), k, subs) for k, n in enumerate(dealt[:, i].tolist()) if n]
            shard = np.repeat(np.arange(shards), dealt[:, len(given) + i]).tolist()
            single += [(mix, s, *draw, k, subs) for draw, k in zip(parts[i], shard)]
    schema = "mix_id string, source string, block int, copy int, limit double, shard int, subs int"
    long = spark.createDataFrame(ranges, "mix_id string, source string, low bigint, n bigint, blocks int, step int, shard int, subs int")
    at = long.withColumn("i", F.explode(F.sequence("low", F.col("low") + F.col("n") - 1))).withColumn("copy", F.expr("cast(i div blocks as int)"))
    block = F.pmod(F.col("i") % F.col("blocks") * F.col("step") + F.col("copy"), "blocks").cast("int")
    whole = at.select("mix_id", "source", block.alias("block"), "copy", F.lit(None).cast("double").alias("limit"), "shard", "subs")
    return placed, whole.unionByName(spark.createDataFrame(single, schema))


def _last(rows: DataFrame) -> DataFrame:
    """Of the documents of each quota's last blocks those that fill the rest of it.

    Documents are hashed into PARTS parts; parts are taken whole in order as long as they fit, by their sums; then single documents
    of the next LAST_PARTS parts, and of what is left the one document that closes the gap best, if it halves it.
    """
    quota = ["mix_id", "source", "copy"]
    parted = rows.withColumn("__part", F.pmod(F.xxhash64(F.lit(SEED + 3), "mix_id", "key"), F.lit(PARTS)).cast("int"))
    sums = parted.groupBy(*quota, "limit", "__part").agg(F.sum("tokens").alias("t"))
    w = Window.partitionBy(*quota).orderBy("__part")
    sums = sums.withColumn("__end", F.sum("t").over(w)).withColumn("__fits", F.col("__end") <= F.col("limit"))
    # the parts before the first that doesn't fit, and how many are beyond
    sums = sums.withColumn("__out", F.sum((~F.col("__fits")).cast("int")).over(w))
    filled = F.coalesce(F.max(F.when(F.col("__fits"), F.col("__end"))).over(Window.partitionBy(*quota)), F.lit(0))
    kept = sums.withColumn("__rest", F.col("limit") - filled).where(F.col("__out") <= LAST_PARTS).select(*quota, "__part", "__fits", "__rest")
    near = parted.join(kept, [*quota, "__part"])
    draw = Window.partitionBy(*quota)
    edge = near.where(~F.col("__fits"))
    order = draw.orderBy(F.xxhash64(F.lit(SEED + 1), "mix_id", "key"), "key")
    small = F.col("tokens") <= F.col("__rest")
    edge = edge.withColumn("__until", F.sum(F.when(small, F.col("tokens")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("__in", small & (F.col("__until") <= F.col("__rest")))
    edge = edge.withColumn("__gap", F.col("__rest") - F.coalesce(F.max(F.when(F.col("__in"), F.col("__until"))).over(draw), F.lit(0)))
    miss = F.when(~F.col("__in"), F.abs(F.col("tokens") - F.col("__gap")))
    edge = edge.withColumn("__miss", miss).withColumn("__nth", F.row_number().over(draw.orderBy(F.col("__miss").asc_nulls_last(), "key")))
    chosen = edge.where("__in or (__nth = 1 and __miss < __gap / 2)")
    return near.where("__fits").select(*rows.columns).unionByName(chosen.select(*rows.columns))


def mixed(docs: DataFrame, weights: DataFrame, key: str, total: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """mix_id, shard, pos, key, source, copy, tokens of each chosen document; docs as from sized()."""
    placed, draws = plan(docs, weights, total, shard_tokens)
    joined = placed.join(draws, ["source", "block"])
    chosen = joined.where("limit is null").unionByName(_last(joined.where("limit is not null")))
    sub = F.pmod(F.xxhash64(F.lit(SEED + 4), "mix_id", "key", "copy"), "subs").cast("int")
    placed_in = chosen.withColumn("shard", F.col("shard") * F.col("subs") + sub)
    local = Window.partitionBy("mix_id", "shard").orderBy(F.xxhash64(F.lit(SEED + 2), "mix_id", "key", "copy"), "key", "copy")
    return placed_in.select("mix_id", "shard", F.row_number().over(local).alias("pos"), F.col("key").alias(key), "source", "copy", "tokens")


def shares(docs: DataFrame, weights: DataFrame, key: str, total: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """For each mixture and source: tokens there, wanted, within the cap and chosen, and the shares these are of the mixture's total.

    target_share is of the wanted total, reachable_share and actual_share are of what all sources of the mixture can give and give.
    """
    size = docs.agg(F.sum("tokens")).first()[0] or 0 if total is None else total
    chosen = mixed(docs, weights, key, total, shard_tokens).groupBy("mix_id", "source").agg(F.sum("tokens").alias("chosen_tokens"), F.count("*").alias("chosen_documents"))
    there = docs.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    wanted = weights.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum(F.greatest(F.lit(0.0), F.coalesce("target_share", F.lit(0.0)))).alias("w"), F.min("max_repeats").alias("max_repeats"))
    mix = Window.partitionBy("mix_id")
    report = wanted.join(there, "source", "left").join(chosen, ["mix_id", "source"], "left").fillna(0, ["source_tokens", "chosen_tokens", "chosen_documents"])
    report = report.withColumn("target_share", F.coalesce(F.try_divide("w", F.sum("w").over(mix)), F.lit(0.0))).withColumn("target_tokens", F.col("target_share") * size)
    most = F.when(F.col("max_repeats").isNull(), F.when(F.col("source_tokens") > 0, float("inf")).otherwise(0.0)).otherwise(F.greatest(F.lit(0), "max_repeats") * F.col("source_tokens"))
    report = report.withColumn("reachable_tokens", F.least("target_tokens", most))
    return report.select(
        "mix_id", "source", "max_repeats", "source_tokens", "target_tokens", "reachable_tokens", "chosen_tokens", "chosen_documents", "target_share",
        F.try_divide("reachable_tokens", F.sum("reachable_tokens").over(mix)).alias("reachable_share"),
        F.try_divide("chosen_tokens", F.sum("chosen_tokens").over(mix)).alias("actual_share"), F.try_divide("chosen_tokens", "source_tokens").alias("repeats"),
    )
