"""Understanding of questions: kind, retrieval profile, expansion by rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Retrieval profile of each kind: results, least score, mode, rerank strategy, whether the graph is asked, and sampling (temperature, top_p, top_k, tokens, repeat penalty).
PROFILES = {
    "entity": (16, 0.35, "entity", "hybrid", True, 0.0, 1.0, 5, 10000, None),
    "factual": (15, 0.45, "balanced", "listwise_llm", False, 0.3, 0.85, 20, 3200, 1.1),
    "wide": (12, 0.38, "wide", "hybrid", True, 0.3, 1.0, 2, 7200, 1.2),
}
PROFILE_COLUMNS = ["limit", "threshold", "mode", "rerank_strategy", "use_graph", "temperature", "top_p", "top_k", "max_tokens", "repeat_penalty"]


def kind(query: Column, rules: list[tuple[str, str, str | None]]) -> Column:
    """The kind of the first rule that fits a question, null if none does.

    rules: a table given by the caller in order of precedence: kind, pattern on the question in small letters without punctuation,
    and a pattern on the question as it is that must not occur (or None).
    """
    plain = F.trim(F.regexp_replace(F.lower(F.trim(query)), "[?!.,;:]", ""))
    out = F.lit(None).cast("string")
    for name, pattern, barred in reversed(rules):
        fits = plain.rlike(pattern) if barred is None else plain.rlike(pattern) & ~query.rlike(barred)
        out = F.when(fits, name).otherwise(out)
    return out


def classified(df: DataFrame, query: str, rules: list[tuple[str, str, str | None]], said: str | None = None, links: list[str] | None = None) -> DataFrame:
    """df with kind, confidence and search_mode: by rule (confidence 1), else by a model's JSON answer, else factual with 0.5.

    said: column of the model's answer ({"type": ..., "confidence": ...}, also among other text); what can't be read counts as no
    answer. A question that holds one of the patterns of links is searched in the mode of entities, whatever its kind.
    """
    q = F.col(query)
    ruled = kind(q, rules)
    none = F.lit(None).cast("struct<type:string,confidence:double>")
    told = F.from_json(F.regexp_extract(F.coalesce(F.col(said), F.lit("")), r"(?s)\{.*\}", 0), "type string, confidence double") if said else none
    known = F.when(told["type"].isin(*PROFILES), told["type"])
    out = df.withColumns({"kind": F.coalesce(ruled, known, F.lit("factual")), "confidence": F.when(ruled.isNotNull(), 1.0).when(known.isNotNull(), F.coalesce(told["confidence"], F.lit(0.5))).otherwise(0.5)})
    mode = F.create_map(*(x for k, v in PROFILES.items() for x in (F.lit(k), F.lit(v[2]))))[F.col("kind")]
    return out.withColumn("search_mode", F.when(T.holds_any(q, links or []), "entity").otherwise(mode))


def with_profile(df: DataFrame, kind_column: str) -> DataFrame:
    """The profile (PROFILE_COLUMNS) of the kind; an unknown kind counts as factual. Hybrid search, transformation, reranking, compression, parents and citations are on for all, memory is off."""
    pick = lambda i: F.when(F.col(kind_column) == "entity", PROFILES["entity"][i]).when(F.col(kind_column) == "wide", PROFILES["wide"][i]).otherwise(PROFILES["factual"][i])
    return df.withColumns({c: pick(i) for i, c in enumerate(PROFILE_COLUMNS)})


def expand(query: Column, synonyms: dict[str, list[str]]) -> Column:
    """Words of a question and the synonyms of rules that fit: phrases it holds, and words or stems that equal a key or begin with it.

    synonyms: a rule table given by the caller, as small as a literal can be.
    """
    q = F.regexp_replace(F.lower(query), "[?!.,;:]", "")
    words = F.filter(F.transform(F.split(q, r"\s+"), lambda t: F.regexp_replace(t, r"[^a-zа-яіїєґёэъы0-9.\-]", "")), lambda t: F.length(t) > 2)
    out = [words]
    for key, values in synonyms.items():
        k = F.lit(key)
        fits = q.contains(k) if " " in key else F.exists(words, lambda t: t.startswith(k) | T.stem(t).startswith(k) | F.startswith(k, T.stem(t)))
        out.append(F.when(fits, F.array(*(F.lit(v.lower()) for v in values))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.concat(*out), lambda w: F.length(w) > 2))


def translations(query: Column, rules: list[tuple[str, str]]) -> Column:
    """The phrases of the rules whose pattern a mostly Latin question holds."""
    hits = F.array(*(F.when(query.rlike("(?i)" + p), F.lit(v)) for p, v in rules))
    return F.when(T.latin_majority(query), F.array_distinct(F.array_compact(hits))).otherwise(F.array().cast("array<string>"))
