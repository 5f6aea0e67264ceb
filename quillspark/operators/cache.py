"""A cache of answers as a table: key, value, expires_at."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import tables


def key(question: Column, *options: Column, group: str = "answer", width: int = 600) -> Column:
    """group:digest of the normalised question and the options; questions that differ in case and blanks share it, and a group is invalidated by its prefix."""
    normal = F.left(F.trim(F.regexp_replace(F.lower(question), r"\s+", " ")), F.lit(width))
    return F.concat(F.lit(f"{group}:"), F.sha2(F.to_json(F.struct(normal.alias("q"), *(o.alias(f"o{i}") for i, o in enumerate(options)))), 256))


def fresh(cache: DataFrame, now: dt.datetime) -> DataFrame:
    return cache.where(F.col("expires_at") > F.lit(now))


def get(requests: DataFrame, cache: DataFrame, now: dt.datetime) -> DataFrame:
    """requests (with key) and the value of each that is cached; null for the others. Requests marked with bypass get none."""
    bypass = F.coalesce(F.col("bypass"), F.lit(False)) if "bypass" in requests.columns else F.lit(False)
    found = requests.join(fresh(cache, now).select("key", F.col("value").alias("__v")), "key", "left")
    return found.withColumn("value", F.when(~bypass, F.col("__v"))).drop("__v")


def put(cache: DataFrame, answers: DataFrame, now: dt.datetime, seconds: int = 180) -> DataFrame:
    """The cache without what expired, and with new answers (key, value)."""
    new = answers.select("key", "value").dropDuplicates(["key"]).withColumn("expires_at", F.lit(now + dt.timedelta(seconds=seconds)))
    return tables.upsert(fresh(cache, now), new, "key")


def invalidate(cache: DataFrame, prefix: str) -> DataFrame:
    return cache.where(~F.col("key").startswith(prefix))
