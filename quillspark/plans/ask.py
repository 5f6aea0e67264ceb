"""Retrieval of several variants of a question, and the prompt made of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import scoring
from quillspark.operators import retrieval
from quillspark.operators.tables import not_parent
from quillspark.session import cut


def retrieve(chunks: DataFrame, variants: DataFrame, limit: int = 10, mode: str = "balanced", size: int = 96) -> DataFrame:
    """query_id, id, fused, rank: hybrid search of each variant (query_id, variant, vector, keywords), fused by reciprocal ranks.

    A question of which no variant finds anything is asked again in the wide mode without a least length.
    """
    mark = F.to_json(F.struct("query_id", "variant"))
    asked = variants.withColumn("vid", mark)
    one = asked.select(F.col("vid").alias("query_id"), "vector", "keywords")
    found = cut(retrieval.hybrid_search(chunks, one, limit, mode, size, shown={}).select(F.col("query_id").alias("vid"), "id", "hybrid_score"))
    named = asked.select("vid", "query_id", "variant")
    lists = named.join(found, "vid")
    missing = named.join(lists.select("query_id").distinct(), "query_id", "left_anti").select("vid")
    again = one.join(missing, F.col("query_id") == F.col("vid"), "left_semi")
    if not again.isEmpty():
        wide = retrieval.hybrid_search(chunks, again, limit, "wide", size, least=0, shown={}).select(F.col("query_id").alias("vid"), "id", "hybrid_score")
        lists = lists.unionByName(named.join(wide, "vid"))
    fused = retrieval.reciprocal_rank_fusion(lists, "query_id", "variant", "id", "hybrid_score")
    w = Window.partitionBy("query_id").orderBy(F.round("fused", 12).desc(), "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def adaptive(chunks: DataFrame, queries: DataFrame, limit: int = 10, trust: float = 0.72, size: int = 96, entity: str | None = None) -> DataFrame:
    """query_id, id, score, hybrid: the nearest chunks of questions whose best three are near enough on average, hybrid search for the others.

    entity: a column that marks questions for a name; of these, one with keywords is sure only if a text of its best three holds one.
    """
    able, more = chunks.where(not_parent()), limit * scoring.MODES["balanced"][3]
    asked, sets, facts = retrieval.prepared(able, queries, size)
    # one search serves both: the nearest ones are the first of what hybrid search takes
    near = cut(retrieval.near_lists(able, asked, facts, more, size))
    mean = F.aggregate(F.slice("vs", 1, 3), F.lit(0.0), lambda acc, v: acc + v) / F.least(F.size("vs"), F.lit(3))
    close = near.where(mean >= trust)
    rest = near.where(mean < trust)
    if entity:
        barred = cut(_nameless(able, queries.where(F.col(entity) & (F.size("keywords") > 0)).select("query_id").distinct(), close, sets, facts))
        rest, close = rest.unionByName(close.join(barred, "query_id", "left_semi")), close.join(barred, "query_id", "left_anti")
    first = close.select("query_id", F.explode(F.slice(F.arrays_zip("ns", "vs"), 1, limit)).alias("x"))
    plain = first.select("query_id", F.col("x.ns").alias("n"), F.col("x.vs").alias("score")).join(facts.select("n", "id"), "n").select("query_id", "id", "score", F.lit(False).alias("hybrid"))
    others = asked.select("qid.*").join(close.select("query_id"), "query_id", "left_anti")
    other = retrieval.ranked(able, sets, facts, rest, others, limit, "balanced", shown={}).select("query_id", "id", F.col("hybrid_score").alias("score"), F.lit(True).alias("hybrid"))
    return plain.unionByName(other)


def _nameless(able: DataFrame, named: DataFrame, near: DataFrame, sets: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id of the queries named of which no text of the best three holds a keyword; what texts hold is known from the facts, so no texts are shuffled."""
    best = near.join(named, "query_id", "left_semi").select("query_id", "kid", F.explode(F.slice("ns", 1, 3)).alias("n"))
    said = facts.select("n", "id", F.transform(F.filter("hits", lambda h: h["tf"] > 0), lambda h: h["needle"]).alias("said"))
    best = best.join(said, "n").join(sets.select("kid", "k"), "kid")
    held = best.where(F.arrays_overlap("said", "k")).select("query_id")
    blank = lambda k: F.trim(k) == ""
    if not sets.where(F.exists("k", blank)).isEmpty():
        # blank keywords are no needles: they are sought in the texts themselves
        texts = able.select("id", F.lower("text").alias("__t"))
        odd = best.where(F.exists("k", blank)).join(texts, "id").where(F.exists("k", lambda k: blank(k) & F.col("__t").contains(k)))
        held = held.unionByName(odd.select("query_id"))
    return near.join(named, "query_id", "left_semi").select("query_id").join(held, "query_id", "left_anti")


def prompt(question: Column, context: Column, history: Column | None = None, facts: Column | None = None, links: Column | None = None) -> Column:
    """The blocks that are there, each under its title, and the question last; context is an array of texts."""
    block = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), body))
    parts = [block("Context", F.array_join(context, "\n\n"))]
    parts += [block(t, b) for t, b in (("Earlier", history), ("Facts", facts), ("Links", links)) if b is not None]
    return F.concat_ws("\n\n", *parts, block("Question", question))


def contexts(results: DataFrame, chunks: DataFrame, most: int = 7) -> DataFrame:
    """query_id, context: the texts of a question's best chunks in order, at most `most`."""
    rows = results.where(F.col("rank") <= most).join(chunks.select("id", "text"), "id").dropDuplicates(["query_id", "rank"])
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("context"))
