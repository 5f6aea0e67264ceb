"""Conversations from message rows (problem 7).

Rows that lack a conversation id get one first. They are joined by reply links (a column that names
the answered message) and quote links (a text that begins with quoted lines "> ..." which are another
message's text or its first line) to each other, in connected components, and to rows with an id: a component whose links lead
to one conversation belongs to it; one that leads to none, or to several, is a conversation of its own.

Then, per conversation: equal rows (conversation, question, answer, time) are one message, known by
its smallest id; the filled field tells the speaker, the role only if neither is filled; rows of a
system role with neither field are no messages. Order: time, at equal times the question first,
then the id. A conversation is dropped if it has no message, a blank one, or one out of turn:
questions and replies must alternate from a question to a reply.

Defined results: a null time sorts first; a text is blank if it is empty or nothing in it is visible;
a row that lacks an id and links is a conversation of its own (and so has no reply: dropped).
No conversation is held by one task: rows are sorted by range, so a long one lies in several
partitions; each piece is numbered and checked by itself, and pieces meet as one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.canon import invisible_class
from quillspark.llm.components import components
from quillspark.session import cut

#: Role names in use, in lower case.
ASSISTANT = ["assistant", "bot", "ai", "model", "gpt", "agent", "system_assistant", "support"]
SYSTEM = ["system", "sys", "developer"]


def visible(text: Column) -> Column:
    """The text without invisible characters and white space of any kind; null stays null."""
    return F.regexp_replace(text, r"[\s\p{Z}\p{Cc}⠀]|" + invisible_class(), "")


def bare(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _quote_links(said: DataFrame) -> DataFrame:
    """(a, b): message a begins with a quotation of all of message b or of its first line. said: message_id, owner, said.

    A text that several conversations hold names no one message and links nothing; copies within a conversation are its first.
    """
    tidy = lambda c: F.array_join(F.transform(F.split(bare(c), r"\r?\n"), bare), "\n")
    head = F.regexp_extract("said", r"\A\s*((?:[ \t]*>[^\n]*\n?)+)", 1)
    quoted = tidy(F.regexp_replace(head, r"(?m)^[ \t]*>", ""))
    quotes = said.where(F.col("said").rlike(r"\A\s*>")).select(F.col("message_id").alias("a"), quoted.alias("q")).where("q <> ''").withColumn("h", F.xxhash64("q"))
    whole = said.select("message_id", "owner", tidy(F.col("said")).alias("w")).where("w <> ''")
    forms = whole.select("message_id", "owner", F.explode(F.array_distinct(F.array("w", F.element_at(F.split("w", "\n"), 1)))).alias("t")).withColumn("h", F.xxhash64("t"))
    # only texts that are quoted are shuffled further
    held = forms.join(quotes.select("h").distinct(), "h", "left_semi").groupBy("h", "t").agg(F.min("message_id").alias("b"), F.min("owner").alias("o"), F.max("owner").alias("p"))
    return quotes.join(held.where("o = p"), "h").where("q = t").select("a", "b")


def _with_ids(messages: DataFrame, reply_to: str | None) -> DataFrame:
    """messages with conv_id: the session; else that of the messages which a component of lost rows answers, quotes or is answered by, if they are of one session; else the component.

    Components are made of lost rows alone, so that a row which points at two sessions cannot join them.
    """
    own = F.when(F.trim(F.coalesce(F.col("session_id"), F.lit(""))) != "", F.col("session_id"))
    lost = messages.where(own.isNull())
    if lost.isEmpty():  # nothing to link
        return messages.withColumn("conv_id", own)
    owner = F.coalesce(own, F.concat(F.lit("\x00"), F.coalesce(F.col("ts").cast("string"), F.lit(""))))
    links = _quote_links(messages.select("message_id", owner.alias("owner"), F.coalesce("query", "answer").alias("said")).where("said is not null"))
    if reply_to:
        links = links.unionByName(messages.select(F.col("message_id").alias("a"), F.col(reply_to).alias("b")).where("b is not null"))
    gone = lost.select("message_id")
    known = messages.where(own.isNotNull()).select(F.col("message_id").alias("k"), own.alias("session"))
    both = links.where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(gone.withColumnRenamed("message_id", "a"), "a", "left_semi")
    both = cut(both.distinct())  # each link of a lost row, from its side
    inner = both.join(gone.withColumnRenamed("message_id", "b"), "b", "left_semi")
    found = components(inner, "a", "b").select(F.col("vertex").alias("message_id"), "component")
    grouped = gone.join(found, "message_id", "left").select("message_id", F.coalesce("component", "message_id").alias("component"))
    sessions = both.join(known, F.col("b") == F.col("k")).select(F.col("a").alias("message_id"), "session").join(grouped, "message_id").groupBy("component").agg(F.min("session").alias("s"), F.max("session").alias("t"))
    placed = grouped.join(sessions, "component", "left").select("message_id", F.when(F.col("s") == F.col("t"), F.col("s")).otherwise(F.concat(F.lit("linked-"), F.col("component").cast("string"))).alias("__c"))
    return messages.join(placed, "message_id", "left").withColumn("conv_id", F.coalesce(own, "__c")).drop("__c")


def rebuild(messages: DataFrame, reply_to: str | None = None, with_text: bool = True) -> DataFrame:
    """conv_id, pos, message_id, role (user, assistant), ts and text (unless it isn't asked for) of the messages of each kept conversation."""
    wanted = ["message_id", "session_id", "role", "query", "answer", "ts", *([reply_to] if reply_to else [])]
    rows = _with_ids(messages.select(*wanted), reply_to)
    once = rows.groupBy("conv_id", "query", "answer", "ts").agg(F.min("message_id").alias("message_id"), F.min(F.struct("message_id", "role"))["role"].alias("role"))
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    empty = F.col("query").isNull() & F.col("answer").isNull()
    said = once.where(~(empty & role.isin(SYSTEM)))
    speaker = F.when(F.col("query").isNotNull(), "user").when(F.col("answer").isNotNull(), "assistant").when(role.isin(ASSISTANT), "assistant").otherwise("user")
    text = F.coalesce("query", "answer")
    blank = F.coalesce(visible(text), F.lit("")) == ""
    said = said.select("conv_id", "message_id", "ts", speaker.alias("role"), blank.alias("blank"), *([text.alias("text")] if with_text else []))
    line = [F.col("ts").asc_nulls_first(), F.desc("role"), F.col("message_id")]
    # the range a row falls into is written down, so that a lost executor can't change it
    placed = cut(said.repartitionByRange(F.col("conv_id"), *line).withColumn("part", F.spark_partition_id()))
    piece = Window.partitionBy("conv_id", "part")
    rows = placed.withColumns({"nth": F.row_number().over(piece.orderBy(*line)), "before": F.lag("role").over(piece.orderBy(*line))})
    wrong = F.col("blank") | F.coalesce(F.col("before") == F.col("role"), F.lit(False))
    pieces = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max(wrong).alias("wrong"), F.min_by("role", "nth").alias("first"), F.max_by("role", "nth").alias("last"))
    # a conversation has no more pieces than there are partitions
    conv = Window.partitionBy("conv_id")
    ordered = conv.orderBy("part")
    joints = pieces.withColumns({"skip": F.sum("n").over(ordered) - F.col("n"), "joint": F.coalesce(F.lag("last").over(ordered) == F.col("first"), F.lit(False)), "begin": F.first("first").over(ordered), "end": F.last("last").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    broken = F.max(F.col("wrong") | F.col("joint") | (F.col("begin") != "user") | (F.col("end") != "assistant")).over(conv)
    kept = joints.withColumn("broken", broken).where(~F.col("broken")).select("conv_id", "part", "skip")
    return rows.join(kept, ["conv_id", "part"]).select("conv_id", (F.col("skip") + F.col("nth")).cast("int").alias("pos"), "message_id", "role", *(["text"] if with_text else []), "ts")
