"""Oversized texts cut at natural boundaries with a given overlap (problem 4).

One regular expression per limit, built from bounded quantifiers: its alternatives, in order of
boundary strength (end of text, blank line, line end, sentence end, white space, any character that
no combining mark follows), take as much as the core size allows, but at least half of it, except for the
last piece. The matches cover the text without gaps; SQL array functions look back over the
preceding matches and put the overlap in front of each.

A piece has at most `limit` characters (Unicode code points): a core of limit - overlap and the
overlap. Consecutive pieces share exactly the overlap.

Defined results: null, empty texts and texts within the limit give no pieces; an overlap of the
limit or more is halved to limit // 2 here (callers reject it where it counts as an error); limits
under 2 give single characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The options in force where a file names none.
PARENT_SIZE, CHILD_SIZE, OVERLAP = 4000, 1200, 150
#: Boundaries from strong to weak, as look-behinds of bounded length.
BOUNDARIES = [r"(?<=\n[ \t\r]{0,3}\n)", r"(?<=\n)", r"(?<=[.!?…;]['\"”»)\]]{0,2}\s{1,2})", r"(?<=\s)", r"(?!\p{M})"]


def cut_pattern(core: Column) -> Column:
    """The expression that takes one core of at most `core` characters."""
    top = core.cast("string")
    low = F.greatest(F.lit(1), F.floor(core / 2)).cast("string")
    steps = [F.concat(F.lit("|.{"), low, F.lit(","), top, F.lit("}" + b)) for b in BOUNDARIES]
    return F.concat(F.lit("(?s).{1,"), top, F.lit("}\\z"), *steps, F.lit("|.{1,"), top, F.lit("}"))


def pieces(df: DataFrame, text: str, limit: str, overlap: str) -> DataFrame:
    """The rows of df whose text is longer than limit, once for each piece, with piece_no from 0, start_index and piece."""
    df = df.drop("piece_no", "start_index", "piece")  # columns of these names give way
    size = F.greatest(F.col(limit), F.lit(1))
    lap = F.when(F.col(overlap) >= size, F.floor(size / 2)).otherwise(F.greatest(F.col(overlap), F.lit(0))).cast("int")
    long = df.where(F.length(text) > size).withColumn("__lap", lap).withColumn("__core", (size - lap).cast("int"))
    cores = long.withColumn("__cores", F.regexp_extract_all(F.col(text), cut_pattern(F.col("__core")), F.lit(0)))
    # every core but the last has at least half the core size, so a few of them hold the overlap
    back = (F.ceil(F.col("__lap") / F.greatest(F.lit(1), F.floor(F.col("__core") / 2))) + 1).cast("int")
    starts = F.aggregate(
        "__cores", F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(c)))
    )
    starts = cores.withColumn("__back", back).withColumn("__starts", starts)

    def piece(core: Column, i: Column) -> Column:
        first = F.greatest(F.lit(1), i - F.col("__back") + 1)
        before = F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice("__cores", first, i - first + 1), ""))
        lead = F.right(before, F.col("__lap"))
        return F.struct(
            i.alias("piece_no"),
            (F.element_at("__starts", i + 1) - F.length(lead)).alias("start_index"),
            F.concat(lead, core).alias("piece"),
        )

    out = starts.withColumn("__p", F.explode(F.transform("__cores", piece)))
    return out.select(*df.columns, "__p.piece_no", "__p.start_index", "__p.piece")


def newest_options(options: DataFrame) -> DataFrame:
    """The newest row of each file, with defaults and rejection; sizes under 1 and negative overlaps count as null."""
    order = F.struct(F.col("updated_at").isNotNull(), "updated_at", "parent_size", "child_size", "overlap")
    last = options.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max(order).alias("o"))
    return last.select("file_id", F.col("o.parent_size").alias("parent_size"), F.col("o.child_size").alias("child_size"), F.col("o.overlap").alias("overlap"))


def oversized(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """id, field, piece_no, start_index, piece of each chunk text and parent text beyond its file's limit."""
    rows = chunks.select("id", "file_id", "level", "text", "parent_text")
    joined = rows.join(newest_options(options), "file_id", "left")
    positive = lambda c, default: F.coalesce(F.when(F.col(c) > 0, F.col(c)), F.lit(default))
    parent, child = positive("parent_size", PARENT_SIZE), positive("child_size", CHILD_SIZE)
    lap = F.coalesce(F.when(F.col("overlap") >= 0, F.col("overlap")), F.lit(OVERLAP))
    text_limit = F.when(F.col("level") == 0, parent).otherwise(child)
    fields = F.array(
        F.struct(F.lit("text").alias("field"), F.col("text").alias("value"), text_limit.alias("limit")),
        F.struct(F.lit("parent_text").alias("field"), F.col("parent_text").alias("value"), parent.alias("limit")),
    )
    long = F.filter(fields, lambda f: F.length(f["value"]) > f["limit"])
    values = joined.where(lap < child).select("id", lap.alias("overlap"), F.explode(long).alias("f"))
    return pieces(values.select("id", "f.field", "f.value", "f.limit", "overlap"), "value", "limit", "overlap").drop("value")
