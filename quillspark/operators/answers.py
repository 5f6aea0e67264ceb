"""Work on ranked results and answers: reranking, compression, citations, confidence, grounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import scoring, text as T
from quillspark.functions import vectors

#: Fixed value: what stands for an answer without support.
FALLBACK = "Немає релевантної відповіді"


def listwise(results: DataFrame, answers: DataFrame, group: str) -> DataFrame:
    """results with rerank_score from a model's ranking of the group (a JSON list of places from 1): 1 - position / n, 0 if missing; the old score if the answer has no list.

    results: group, pos (from 1), score; answers: group, answer.
    """
    ranks = F.from_json(F.regexp_extract("answer", r"\[[\d,\s]+\]", 0), "array<int>")
    n = F.count("*").over(Window.partitionBy(group))
    rows = results.join(answers.select(group, ranks.alias("__r")), group, "left").withColumn("__n", n)
    valid = F.filter("__r", lambda r: (r >= 1) & (r <= F.col("__n")))
    place = F.array_position(valid, F.col("pos"))
    score = F.when(F.col("__r").isNull(), F.coalesce("score", F.lit(0.0))).when(place > 0, 1 - (place - 1) / F.col("__n")).otherwise(0.0)
    return rows.withColumn("rerank_score", score).drop("__r", "__n")


def pointwise(score: Column, answer: Column) -> tuple[Column, Column]:
    """(rerank score, final score) from a model's 0..10: a tenth of it; 0.5 and the old score if it is no number."""
    number = F.regexp_extract(F.trim(answer), r"^[-+]?\d*\.?\d+", 0).try_cast("double") / 10
    return F.coalesce(number, F.lit(0.5)), F.coalesce(number, score, F.lit(0.5))


def embedding_rerank(query: Column, stored: Column, embedded: Column) -> Column:
    """Similarity of a question's vector to the stored one of a result, to that of its text where none is stored (embedded); 0 without both."""
    own = F.when(F.size(stored) > 0, stored)
    return F.coalesce(vectors.cosine(query, own), vectors.cosine(query, embedded), F.lit(0.0))


def hybrid_rerank(score: Column, similarity: Column) -> Column:
    return 0.3 * F.coalesce(score, F.lit(0.0)) + 0.7 * similarity


def top(results: DataFrame, group: str, score: str, item: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.round(score, 9).desc_nulls_last(), item)
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def compress(pairs: DataFrame, key: list[str], query: str, body: str, budget: int = 500, candidates: int = 15, similarity: Callable[[Column], Column] | None = None) -> DataFrame:
    """key and the sentences of body that share most words with query, as many as fit the budget of words, and what share of the text they are.

    similarity: of a sentence to the question (such as the cosine of their vectors); with it the `candidates` of most shared words are taken in its order.
    The first sentence beyond the budget ends the choice. Sentences of one text stay together in a row.
    """
    clean = lambda w: F.regexp_replace(w, r"[^a-zа-яіїєґ]", "")
    asked = F.array_distinct(F.filter(F.transform(F.split(F.lower(F.col(query)), r"\s+"), clean), lambda w: F.length(w) > 2))
    rows = pairs.select(*key, F.col(body).alias("__b"), asked.alias("__q"), T.marked_sentences(F.col(body)).alias("__s"))
    letters = lambda s: F.regexp_replace(F.lower(s), r"[^a-zа-яіїєґ\s]", "")
    shared = lambda s: F.size(F.filter(F.split(letters(s), r"\s+"), lambda w: F.array_contains(F.col("__q"), w)))
    ranked = F.array_sort(F.transform("__s", lambda s, i: F.struct((-shared(s)).alias("m"), i.alias("i"), s.alias("s"), F.size(F.split(s, r"\s+")).alias("n"))))
    chosen = F.slice(ranked, 1, candidates)
    if similarity is not None:
        nearest = F.array_sort(F.transform("__r", lambda s: F.struct(F.round(-similarity(s["s"]), 9).alias("d"), s["i"].alias("i"), s["s"].alias("s"), s["n"].alias("n"))))
        rows = pairs.select(*key, F.col(query).alias("__query"), F.col(body).alias("__b"), asked.alias("__q"), T.marked_sentences(F.col(body)).alias("__s")).withColumn("__r", chosen).withColumn("__r", nearest)
    else:
        rows = rows.withColumn("__r", chosen)
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        fits = ~acc["full"] & (acc["n"] + s["n"] <= budget)
        return F.struct(F.when(fits, F.concat(acc["out"], F.array(s["s"]))).otherwise(acc["out"]).alias("out"), F.when(fits, acc["n"] + s["n"]).otherwise(acc["n"]).alias("n"), (acc["full"] | ~fits).alias("full"))

    chosen = rows.withColumn("relevant", F.aggregate("__r", empty, step, lambda a: a["out"]))
    out = chosen.withColumn("compressed", F.array_join("relevant", " "))
    return out.select(*key, "relevant", "compressed", F.coalesce(F.try_divide(F.length("compressed"), F.length("__b")), F.lit(0.0)).alias("ratio"))


def compress_hybrid(pairs: DataFrame, key: list[str], query: str, body: str, said: str, mode: str | None = None, budget: int = 500) -> DataFrame:
    """key and compressed: the extract at half as much again as the budget; where that is longer than four characters a word of it, what a model said (said).

    Rows of the mode entity and rows for which both fail keep the whole text.
    """
    out = compress(pairs, [*key, body, said, *([mode] if mode else [])], query, body, int(budget * 1.5))
    short = F.when(F.length("compressed") > 4 * budget, F.col(said)).otherwise(F.col("compressed"))
    kept = F.when(F.coalesce(short, F.lit("")) == "", F.col(body)).otherwise(short)
    return out.select(*key, (F.when(F.col(mode) == "entity", F.col(body)).otherwise(kept) if mode else kept).alias("compressed"))


def holds(low: Column, needle: Column, share: float = 0.6) -> Column:
    """More than this share of the needle's words of three and more characters occur in a text in small letters."""
    words = F.filter(F.split(F.lower(needle), r"\s+"), lambda w: F.length(w) > 2)
    return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: low.contains(w))) > share * F.size(words))


def citations(answers: DataFrame, docs: DataFrame, group: str) -> DataFrame:
    """group, number, doc_pos, id, sentence of each sentence (of 20 and more characters) of a document that an answer uses; documents are numbered by first use.

    answers: group, answer; docs: group, doc_pos, id, text.
    """
    found = F.regexp_extract_all("text", F.lit(r"[^.!?…]+[.!?…]+"), F.lit(0))
    # made before the join: inside the test it would be made again for every word
    low = answers.select(group, F.lower("answer").alias("__low"))
    rows = docs.join(low, group).select(group, "__low", "doc_pos", "id", F.posexplode(found).alias("n", "sentence"))
    used = rows.where((F.length("sentence") >= 20) & holds(F.col("__low"), F.col("sentence")))
    number = F.dense_rank().over(Window.partitionBy(group).orderBy("doc_pos"))
    return used.select(group, number.alias("number"), "doc_pos", "id", "n", "sentence")


def cited(answers: DataFrame, cites: DataFrame, group: str) -> DataFrame:
    """answers with [number] behind the first occurrence of each cited sentence's first 50 characters."""
    marks = cites.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("doc_pos", "n", F.left("sentence", F.lit(50)).alias("a"), F.concat(F.lit(" ["), F.col("number"), F.lit("]")).alias("m")))).alias("marks"))
    rows = answers.join(marks, group, "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<doc_pos:int,n:int,a:string,m:string>>")))

    def step(acc: Column, s: Column) -> Column:
        at = F.position(s["a"], acc)
        end = at + F.length(s["a"]) - 1
        return F.when(at > 0, F.concat(F.left(acc, end), s["m"], F.substr(acc, end + 1))).otherwise(acc)

    return rows.withColumn("formatted", F.aggregate("marks", F.col("answer"), step)).drop("marks")


def confidence(answers: DataFrame, chunks: DataFrame, group: str, similarity: Column, compare: int = 5) -> DataFrame:
    """group, score, tier, best (place among those compared): the most similar of the first chunks that hold a word of the answer; 0 and LOW if there is none.

    answers: group, answer, vector; chunks: group, pos, text, embedding; similarity: of the two vectors.
    """
    words = F.regexp_extract_all(F.lower("answer"), F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    rows = chunks.withColumn("__t", F.lower("text")).join(answers.withColumn("__w", words), group)
    rows = rows.where((F.trim("answer") != "") & F.exists("__w", lambda w: F.col("__t").contains(w)))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy("pos")) - 1).where(F.col("__n") < compare)
    best = rows.withColumn("__s", similarity).where("__s is not null").groupBy(group).agg(F.max(F.struct(F.col("__s").alias("s"), (-F.col("__n")).alias("n"))).alias("b"))
    joined = answers.select(group).join(best, group, "left")
    score = F.coalesce("b.s", F.lit(0.0))
    return joined.select(group, score.alias("score"), scoring.tier(score).alias("tier"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("best"))


def verify(score: Column, tier: Column, opinion: Column, gate: float = 0.65, verdict: float = 0.15) -> tuple[Column, Column]:
    """(grounded, verdict): HIGH is, LOW isn't; between them the mean of score and a model's opinion decides."""
    asked = tier == "GRAY_ZONE"
    grounded = F.when(tier == "HIGH", True).when(asked, (score + opinion) / 2 >= gate).otherwise(False)
    return grounded, F.when(asked, F.when(opinion >= verdict, "YES").otherwise("NO"))


def final_answer(answer: Column, grounded: Column, tier: Column, verdict: Column) -> tuple[Column, Column]:
    """(answer or the fallback, whether it was kept)."""
    reject = ~grounded | (tier == "LOW") | (~grounded & (F.coalesce(verdict, F.lit("")) == "NO"))
    return F.when(reject, FALLBACK).otherwise(answer), ~reject


def verified_texts(sources: Column, citations: Column) -> Column:
    """What an answer is verified with: the texts of its sources, else those of its citations; blank ones don't count."""
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.when(F.size(some(sources)) > 0, some(sources)).otherwise(some(citations))


def grounded_answer(answer: Column, sources: Column, citations: Column, grounded: Column, tier: Column, verdict: Column) -> Column:
    """The answer by the grounding policy; as it is if it is blank or there is nothing to verify it with."""
    kept, _ = final_answer(answer, grounded, tier, verdict)
    return F.when((F.trim(F.coalesce(answer, F.lit(""))) == "") | (F.size(verified_texts(sources, citations)) == 0), answer).otherwise(kept)
