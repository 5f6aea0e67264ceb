"""Conversation turns and feedback: history, pruning, session lists, evaluation sets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _recent() -> list[Column]:
    return [F.col("ts").desc_nulls_last(), F.col("id").desc()]


def prune(turns: DataFrame, keep: int = 50) -> DataFrame:
    """The newest `keep` turns of each session; Spark limits each partition before it shuffles."""
    w = Window.partitionBy("session_id").orderBy(*_recent())
    return turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


def history(turns: DataFrame, last: int = 5) -> DataFrame:
    """The last turns of each session with pos from 1, oldest first."""
    rows = prune(turns, last)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_first(), "id")))


def first_turns(turns: DataFrame, first: int = 100) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_first(), "id")
    return turns.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= first)


def session_list(turns: DataFrame, newest: int = 500, width: int = 60) -> DataFrame:
    """The sessions of the newest turns of all: label (newest question, cut), last activity, turns among these."""
    top = turns.orderBy(*_recent()).limit(newest)
    label = F.max_by("query", F.struct("ts", "id"))
    heads = top.groupBy("session_id").agg(label.alias("q"), F.max("ts").alias("last_activity"), F.count("*").alias("turn_count"))
    cut = F.concat(F.left("q", F.lit(width)), F.when(F.length("q") > width, "…").otherwise(""))
    return heads.select("session_id", cut.alias("first_message"), "last_activity", "turn_count")


def session_count(turns: DataFrame) -> DataFrame:
    return turns.agg(F.countDistinct("session_id").alias("sessions"))


def without_old(turns: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Turns after the cutoff, and those without a time."""
    return turns.where(F.col("ts").isNull() | (F.col("ts") > F.lit(cutoff)))


def cleared(turns: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Turns without those of the sessions in gone (session_id); without gone, none at all."""
    return turns.where("false") if gone is None else turns.join(gone.select("session_id").where("session_id is not null").distinct(), "session_id", "left_anti").select(*turns.columns)


def created(feedback: DataFrame, new: DataFrame, now: dt.datetime) -> DataFrame:
    """feedback with the new records, which are pending and made now."""
    stamped = new.withColumns({"status": F.lit("pending"), "created_at": F.lit(now), "updated_at": F.lit(now)})
    return feedback.unionByName(stamped.select(*feedback.columns))


def feedback_list(feedback: DataFrame, status: str, limit: int) -> DataFrame:
    """The newest records of a status (whatever its case)."""
    return feedback.where(F.lower("status") == status).orderBy(F.col("created_at").desc_nulls_last(), "id").limit(limit)


def set_status(feedback: DataFrame, which: Column, status: str) -> DataFrame:
    """feedback with the status of the rows that which holds for."""
    return feedback.withColumn("status", F.when(which, status).otherwise(F.col("status")))


def evaluation_cases(feedback: DataFrame) -> DataFrame:
    """id, grounded, coverage, score of approved feedback; a missing score counts as half, scores are kept within 0 and 1."""
    score = F.coalesce(F.col("score") / 5.0, F.lit(0.5))
    rows = feedback.where(F.lower("status") == "approved").withColumn("__s", score)
    coverage = F.when(F.coalesce("correction_text", F.lit("")) != "", 0.9).when(F.col("__s") >= 0.6, 0.7).otherwise(0.3)
    return rows.select(F.concat(F.lit("feedback-"), "id").alias("id"), (F.col("__s") >= 0.6).alias("grounded"), coverage.alias("coverage"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__s")).alias("score"))


def evaluate(cases: DataFrame, grounded: float = 0.72, coverage: float = 0.55, score: float = 0.58) -> DataFrame:
    """One row: the means and whether all reach their thresholds; zeros and a failure without cases."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    row = cases.agg(F.count("*").alias("cases"), mean(F.col("grounded").cast("double")).alias("grounded_rate"), mean(F.col("coverage")).alias("coverage"), mean(F.col("score")).alias("score"))
    return row.withColumn("passed", (F.col("cases") > 0) & (F.col("grounded_rate") >= grounded) & (F.col("coverage") >= coverage) & (F.col("score") >= score))


def pass_rate(results: DataFrame, passed: str, least: float = 0.6) -> DataFrame:
    row = results.agg(F.count("*").alias("total"), F.count_if(F.col(passed)).alias("passed"))
    return row.withColumn("rate", F.coalesce(F.try_divide("passed", "total"), F.lit(0.0))).withColumn("ok", F.col("rate") >= least)


def histogram(scores: DataFrame, group: str, score: str, bins: int = 5) -> DataFrame:
    """group, n, min, max, mean, median, p75, counts: equal bins, the last one closed; quantiles are values of the sorted list, not interpolated.

    Only finite scores count; a group without any has no row. Values are counted before they meet, so a
    large group costs one row per distinct value.
    """
    valid = scores.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf")))
    each = valid.groupBy(group, F.col(score).alias("s")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    each = each.withColumns({"lo": F.min("s").over(w), "hi": F.max("s").over(w), "n": F.sum("c").over(w), "upto": F.sum("c").over(w.orderBy("s"))})
    span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("s") - F.col("lo")) / span * bins).cast("int"))
    nth = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("s")))
    counts = F.array(*(F.sum(F.when(F.col("bin") == i, F.col("c")).otherwise(0)) for i in range(bins)))
    return each.withColumn("bin", place).groupBy(group).agg(
        F.max("n").alias("n"), F.min("s").alias("min"), F.max("s").alias("max"), (F.sum(F.col("s") * F.col("c")) / F.sum("c")).alias("mean"), nth(0.5).alias("median"), nth(0.75).alias("p75"), counts.alias("counts")
    )
