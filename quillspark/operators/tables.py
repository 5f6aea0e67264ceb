"""Operators on keyed tables: newest version, upsert, delete, lookup, filters compiled from a list."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """One row per key, the newest by `order` (then by all columns' hash); rows without a key stay away."""
    keys = [key] if isinstance(key, str) else key
    ties = F.xxhash64(*[F.col(c) for c in df.columns])
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order), ties)
    rows = df.where(F.col(keys[0]).isNotNull()).withColumn("__n", F.row_number().over(w))
    return rows.where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new rows, and old rows of other keys; null keys of old rows stay."""
    return old.join(new.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old rows, and the first new row of each key that old lacks."""
    fresh = newest(new, key).join(old.select(key).distinct(), key, "left_anti")
    return old.unionByName(fresh.select(*new.columns), allowMissingColumns=True)


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti").select(*df.columns)


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi").select(*df.columns)


def page(df: DataFrame, key: str, size: int, offset: int = 0) -> DataFrame:
    """A page in the order of the key."""
    return df.orderBy(key).offset(offset).limit(size)


def metadata_filter(filters: list[dict[str, Any]]) -> Column:
    """All of the filters ({field, value, operator}) as one predicate that reaches the scan.

    Operators: eq (also any unknown one), ne (keeps rows without the field), in (any of), gt, gte, lt, lte
    (numbers only). Filters without field or value have no effect.
    """
    out = F.lit(True)
    compare = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
    for f in filters or []:
        field, value, op = f.get("field"), f.get("value"), f.get("operator") or "eq"
        if not field or value is None:
            continue
        column = F.col(field)
        if op == "ne":
            out &= ~column.eqNullSafe(F.lit(value))
        elif op == "in" and isinstance(value, (list, tuple)):
            some = [v for v in value if v is not None]
            out &= column.isin(some) if some else F.lit(True)
        elif op in compare:
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                out &= compare[op](column, F.lit(value))
        else:
            out &= column == F.lit(value)
    return out


def not_parent(level: str = "level") -> Column:
    """Chunks of flat strategies have no level; they are no parents."""
    return ~F.col(level).eqNullSafe(F.lit(0))


def has_url(text: Column) -> Column:
    return text.rlike(r"https?://\S+|\b[\w-]+\.[\w.-]+\.\w{2,}\b")


def meaningful(text: Column, least: int = 80) -> Column:
    """Long enough or with an address, and more than a title in brackets."""
    t = F.trim(text)
    return ((F.length(t) >= least) | has_url(text)) & ~t.rlike(r"^\[[^\]]{2,60}\][\s\\]*$")


def keep_or_all(df: DataFrame, keep: Column, *group: str) -> DataFrame:
    """The rows to keep of each group; all of a group where none is to be kept."""
    w = Window.partitionBy(*group)
    rows = df.withColumn("__keep", F.coalesce(keep, F.lit(False))).withColumn("__any", F.max("__keep").over(w))
    return rows.where("__keep or not __any").drop("__keep", "__any")


def distinct_context(df: DataFrame, text: str, order: list[Column], limit: int, *group: str) -> DataFrame:
    """The best row of each text (its first 260 normalised characters) of a group, at most `limit` a group; empty texts drop out."""
    form = F.left(F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " ")), F.lit(260))
    rows = df.withColumn("__form", form).where("__form <> ''")
    first = Window.partitionBy(*group, "__form").orderBy(*order)
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return rows.where(F.col("__n") <= limit).drop("__form", "__n")
