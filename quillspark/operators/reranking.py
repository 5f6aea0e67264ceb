"""Which rerank method runs, how many results it keeps, and what comes after: floor, order by names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import scoring
from quillspark.functions import text as T

#: Least scores after a rerank and without one, and how many more candidates a search for names keeps.
FLOOR, BARE_FLOOR = 0.0163, 0.01
WIDER, WIDEST = 4, 24


def kept(mode: Column, limit: Column) -> Column:
    """Results that a rerank keeps: the limit, for names four times as many, 24 at least."""
    return F.when(mode == "entity", F.greatest(limit * WIDER, F.lit(WIDEST))).otherwise(limit)


def rerank(results: DataFrame, group: str, item: str, strategy: Column, mode: Column, limit: Column, finals: dict[str, Column], enabled: Column | None = None, floor: float = FLOOR, bare_floor: float = BARE_FLOOR) -> DataFrame:
    """results (group, item, score, other columns) with method, reranked, score and rank.

    The method is that of the strategy's name; finals gives the final score of each (listwise, llm, hybrid). It runs if it is enabled, isn't none,
    and the group has more results than the limit; then only its best are kept. Results at or below the floor drop out.
    """
    on = F.lit(True) if enabled is None else F.coalesce(enabled, F.lit(False))
    method = F.when(on, scoring.normalized_strategy(strategy)).otherwise("none")
    rows = results.withColumns({"method": method, "__n": F.count("*").over(Window.partitionBy(group))}).withColumn("reranked", (F.col("method") != "none") & (F.col("__n") > limit))
    final = F.col("score")
    for name, column in finals.items():
        final = F.when(F.col("method") == name, column).otherwise(final)
    rows = rows.withColumn("score", F.when(F.col("reranked"), final).otherwise(F.col("score")))
    order = Window.partitionBy(group).orderBy(F.round("score", 9).desc_nulls_last(), item)
    rows = rows.withColumn("rank", F.row_number().over(order)).where(~F.col("reranked") | (F.col("rank") <= kept(mode, limit)))
    return rows.where(F.col("score") > F.when(F.col("method") == "none", bare_floor).otherwise(floor)).drop("__n")


def by_names(results: DataFrame, group: str, item: str, groups: Column) -> DataFrame:
    """results (group, item, text, score) with matches (how many of the names' spelling groups the text or its Latin spelling holds) and place: more matches first, then the score."""
    low, latin = F.lower("text"), T.to_latin(F.col("text"))
    hits = F.size(F.filter(F.coalesce(groups, F.array().cast("array<array<string>>")), lambda g: F.exists(g, lambda v: low.contains(v) | latin.contains(v))))
    rows = results.withColumn("matches", hits)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("matches"), F.round("score", 9).desc_nulls_last(), item)))
