"""Substring matching of many needles in many texts without pairing all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Needles, and their characters, that one automaton holds at most; it goes to every task, some 100 bytes a character.
MOST_NEEDLES, MOST_CHARACTERS = 50_000, 1_000_000


def contains(needles: DataFrame, texts: DataFrame, **measures: Column) -> DataFrame:
    """needle, id and measures (columns made of needle and text) of each needle (a column of that name) that occurs in a text (id, text); both in small letters.

    Needles are counted first. Up to MOST_NEEDLES, an automaton of all of them reads each text once, and nothing is shuffled but
    the needles; more than that meet the words of the texts in a join. Null and blank needles match nothing; a text repeated under its id is found repeatedly.
    """
    asked = needles.select(F.lower("needle").alias("needle")).where("trim(needle) <> ''").distinct()
    low = texts.select("id", F.lower("text").alias("text")).where("text is not null")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("needle")), F.lit(0)).alias("c")).first()
    if size["n"] == 0:
        return low.where("false").select(F.lit("").alias("needle"), "id", *(c.alias(n) for n, c in ((n, F.lit(None)) for n in measures)))
    found = _by_automaton(asked, low) if size["n"] <= MOST_NEEDLES and size["c"] <= MOST_CHARACTERS else _by_words(asked, low)
    return found.select("needle", "id", *(c.alias(n) for n, c in measures.items()))


def _by_automaton(asked: DataFrame, low: DataFrame) -> DataFrame:
    """needle, id, text by one reading of each text."""
    listed = [r["needle"] for r in asked.collect()]  # MOST_NEEDLES at most
    shared = asked.sparkSession.sparkContext.broadcast(sorted(listed))
    kind = low.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in shared.value:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            hits = [sorted({w for _, w in automaton.iter(t)}) for t in batch.column(1).to_pylist()]
            some = pa.array([i for i, h in enumerate(hits) if h], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some).cast(to_arrow_type(kind)), batch.column(1).take(some), pa.array([h for h in hits if h], pa.list_(pa.string()))], names=["id", "text", "found"])

    return low.mapInArrow(run, f"id {kind.simpleString()}, text string, found array<string>").select(F.explode("found").alias("needle"), "id", "text")


def _by_words(asked: DataFrame, low: DataFrame) -> DataFrame:
    """needle, id, text by a join, for any number of needles.

    A needle's first word lies within one word of the text. Needles and the distinct words of all texts meet on the
    first three characters of that word (fewer for shorter ones), then words lead back to texts, where the whole needle is checked.
    """
    asked = asked.withColumn("__f", F.element_at(F.split(F.trim("needle"), r"\s+"), 1)).withColumn("__g", F.left("__f", F.lit(3)))
    listed = low.select("id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("__w"))
    words = listed.select("__w").distinct()
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("__w") - n + 1)), lambda i: F.substr(F.col("__w"), i, n))))
    parts = words.where("__w <> ''").select("__w", F.explode(F.array_distinct(grams)).alias("__g"))
    pairs = asked.join(parts, "__g").where(F.col("__w").contains(F.col("__f"))).select("needle", "__w").distinct()
    found = pairs.join(listed, "__w").select("needle", "id").distinct()
    return found.join(low, "id").where(F.col("text").contains(F.col("needle"))).select("needle", "id", "text")
