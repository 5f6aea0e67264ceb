"""Answers as ordered events, and streams of turns and events by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import sanitize_output


def events(answers: DataFrame, key: str, answer: str, cites: str | None = None) -> DataFrame:
    """key, seq, event, payload: metadata, one token event per word of the sanitised answer, citations if there are any, done."""
    tokens = F.regexp_extract_all(sanitize_output(F.col(answer)), F.lit(r"\s*\S+"), F.lit(0))
    make = lambda event, payload: F.struct(F.lit(event).alias("event"), payload.cast("string").alias("payload"))
    body = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: make("token", t))
    parts = [F.array(make("metadata", F.to_json(F.struct(F.col(key).alias("key"))))), body]
    if cites:
        parts.append(F.when(F.size(cites) > 0, F.array(make("citations", F.to_json(cites)))).otherwise(F.array().cast("array<struct<event:string,payload:string>>")))
    parts.append(F.array(make("done", F.lit(None))))
    return answers.select(key, F.posexplode(F.concat(*parts)).alias("seq", "e")).select(key, "seq", "e.event", "e.payload")


def frames(stream: DataFrame, key: str) -> DataFrame:
    """key, seq, frame: each event as a frame of server-sent events, up to the first done or error of its key."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("event").isin("done", "error").cast("int")).over(w), F.lit(0))
    frame = F.concat(F.lit("event: "), "event", F.lit("\ndata: "), F.coalesce(F.regexp_replace("payload", "\n", "\ndata: "), F.lit("{}")), F.lit("\n\n"))
    return stream.withColumn("__e", ended).where("__e = 0").select(key, "seq", frame.alias("frame"))


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Events of a first model, and where it ends in an error those of a second one after what was sent (without the error); its tokens may repeat."""
    broken = first.where("event = 'error'").groupBy(key).agg(F.min("seq").alias("__s"))
    kept = first.join(broken, key, "left").where("__s is null or seq < __s").select(*first.columns)
    after = second.join(broken, key).withColumn("seq", (F.col("seq") + F.col("__s")).cast(first.schema["seq"].dataType)).where("event <> 'metadata'").select(*first.columns)
    return kept.unionByName(after)


def settled(stream: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """key, answer of each stream that is done and grounded (verdicts: key, grounded), for the cache: its tokens in order."""
    done = stream.where("event = 'done'").select(key).distinct()
    kept = stream.where("event = 'token'").join(done, key, "left_semi").join(verdicts.where("grounded").select(key), key, "left_semi")
    # an answer is one row to begin with, and its tokens are one again
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda s: s["payload"]), "").alias("answer"))


def deltas(partial: Column, sent: Column) -> Column:
    """What a longer sanitised prefix adds to what was sent; nothing if it isn't a continuation."""
    clean = sanitize_output(partial)
    return F.when(clean.startswith(sent), F.substr(clean, F.length(sent) + 1)).otherwise("")


def lines(chunks: DataFrame, key: str, seq: str, chunk: str) -> DataFrame:
    """key, line, text: the full lines of chunked text in order, as of newline-delimited JSON; the unended tail is the last line.

    A line's number is the count of line ends before it, so only the pieces of one line meet, never a whole stream.
    """
    parts = chunks.select(key, seq, F.posexplode(F.split(F.coalesce(chunk, F.lit("")), "\n")).alias("__i", "__p"))
    ends = F.sum((F.col("__i") > 0).cast("int")).over(Window.partitionBy(key).orderBy(seq, "__i"))
    rows = parts.withColumn("line", ends).groupBy(key, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "__i", "__p"))), lambda s: s["__p"]), "").alias("text"))
    return rows.where("trim(text) <> ''").select(key, "line", "text")


def windowed(events: DataFrame, time: str, group: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Sums by tumbling window and group with a watermark; the same plan for a table and for a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), group, "events", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user, ended by a gap, with a watermark."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("events")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def deduplicated(events: DataFrame, time: str, key: str, late: str = "2 hours") -> DataFrame:
    """Each key once, with state that the watermark bounds."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
