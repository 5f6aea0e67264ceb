"""Scores of retrieval candidates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
#: Weights of vector and keyword scores, keywords wanted and candidates fetched by mode.
MODES = {"entity": (0.35, 0.65, 1, 5), "precise": (0.9, 0.1, 2, 2), "balanced": (0.75, 0.25, 1, 3), "wide": (0.55, 0.45, 1, 4)}
#: Least similarity by mode; null is no limit.
THRESHOLDS = {"precise": 0.75, "balanced": 0.65, "wide": 0.5}


def occurrences(text: Column, word: Column) -> Column:
    """How often word occurs in text, without overlap; 0 for an empty word."""
    return F.when(F.length(word) > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")).otherwise(0)


def bm25(text: Column, keywords: Column, mean_length: Column) -> Column:
    """Sum of saturated term frequencies without inverse document frequency; text and keywords in small letters."""
    length = F.size(F.split(text, r"\s+"))
    rest = K1 * (1 - B + B * F.try_divide(length, mean_length))
    return F.aggregate(keywords, F.lit(0.0), lambda acc, k: acc + occurrences(text, k) * (K1 + 1) / (occurrences(text, k) + rest))


def min_max(value: Column, *group: str) -> Column:
    """0 to 1 over the group; 1 where all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))


def tier(score: Column, high: float = 0.85, low: float = 0.65) -> Column:
    return F.when(score >= high, "HIGH").when(score < low, "LOW").otherwise("GRAY_ZONE")


def parsed_relevance(answer: Column) -> Column:
    """A number within a model's answer, also with a decimal comma, kept within 0 and 1; 0 if there is none."""
    number = F.regexp_extract(F.replace(F.trim(answer), F.lit(","), F.lit(".")), r"^[-+]?\d*\.?\d+", 0)
    # least and greatest pass over nulls, so the default comes first
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number.try_cast("double"), F.lit(0.0))))


def normalized_strategy(name: Column) -> Column:
    """The rerank method that a strategy's name stands for."""
    return F.when(name.isNull() | (name == "none"), "none").when(name.isin("cross_encoder", "listwise_llm"), "listwise").when(name == "llm_based", "llm").otherwise("hybrid")
