import datetime as dt

from quillspark.llm import conversations
from quillspark.llm.components import components

T = dt.datetime(2024, 1, 1)
SCHEMA = "message_id bigint, session_id string, role string, query string, answer string, ts timestamp, reply_to bigint, pos int"


def frame(spark, rows):
    return spark.createDataFrame([(*r[:5], None if r[5] is None else T + dt.timedelta(seconds=r[5]), r[6] if len(r) > 6 else None, 7) for r in rows], SCHEMA)


def kept(df, **kw):
    return sorted((r["conv_id"], r["pos"], r["message_id"]) for r in conversations.rebuild(df, **kw).collect())


def test_rules(spark):
    df = frame(spark, [
        (2, "a", "bot", None, "hello", 1), (1, "a", "bot", "hi", None, 1), (3, "a", "bot", None, "hello", 1), (4, "a", "SYSTEM", None, None, 0),
        (5, "b", None, "hi", None, 1), (6, "c", None, "hi", None, 1), (7, "c", None, None, "​", 2), (8, "d", "ai", None, None, 1),
        (9, "e", "x", None, "reply", 1), (10, "e", "x", "q", None, 2), (11, "f", None, "q", None, 1), (12, "f", None, "q2", None, 2), (13, "f", None, None, "r", 3),
    ])
    assert kept(df) == [("a", 1, 1), ("a", 2, 2)]


def test_one_conversation_over_many_partitions(spark):
    n = 4000
    rows = [(i, "long", None, f"q{i}" if i % 2 == 0 else None, f"a{i}" if i % 2 else None, i // 2) for i in range(n)] + [(n + i, "bad", None, "q", None, i) for i in range(500)]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = conversations.rebuild(frame(spark, rows), with_text=False).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert [(r["conv_id"], r["pos"], r["message_id"]) for r in found] == [("long", i + 1, i) for i in range(n)]


def test_null_time_and_empty(spark):
    df = frame(spark, [(1, "a", None, "q", None, None), (2, "a", None, None, "r", 1)])
    assert kept(df) == [("a", 1, 1), ("a", 2, 2)]
    assert kept(df.limit(0)) == []


def test_lost_ids_by_reply_and_quote(spark):
    df = frame(spark, [(1, None, None, "q1", None, 1), (2, " ", None, None, "r1", 2, 1), (3, None, None, "q9", None, 1), (4, "", None, None, "> q9\nr9", 2), (5, None, None, "alone", None, 1)])
    assert kept(df, reply_to="reply_to") == [("linked-1", 1, 1), ("linked-1", 2, 2), ("linked-3", 1, 3), ("linked-3", 2, 4)]


def test_lost_reply_joins_the_session(spark):
    df = frame(spark, [(1, "S", None, "q", None, 1), (2, None, None, None, "r", 2, 1), (3, "T", None, "q2", None, 1), (4, "T", None, None, "r2", 2), (5, "", None, None, "> q2\n> more", 3)])
    assert kept(df, reply_to="reply_to") == [("S", 1, 1), ("S", 2, 2), ("T", 1, 3), ("T", 2, 4)]


def test_lost_rows_by_quotes_of_known_messages(spark):
    df = frame(spark, [
        (1, "S", None, "first line\nsecond line", None, 1), (2, None, None, None, " > first line\n>second line\nthe reply", 2),
        (3, "A", None, "same", None, 1), (4, "B", None, "same", None, 1), (5, None, None, None, "> same\nwhose?", 2),
        (6, "C", None, "only here", None, 1), (7, None, None, None, "> only here\nyes", 2), (8, None, None, "> yes?\nno", None, 3),
    ])
    assert kept(df) == [("C", 1, 6), ("C", 2, 7), ("S", 1, 1), ("S", 2, 2)]


def test_row_between_two_sessions_joins_none(spark):
    df = frame(spark, [(1, "S", None, "q", None, 1), (2, "S", None, None, "r", 2), (3, "T", None, "q", None, 1), (4, "T", None, None, "r", 2, 3), (5, None, None, "both", None, 3, 2), (6, "T", None, None, "x", 4, 5)])
    assert kept(df, reply_to="reply_to") == [("S", 1, 1), ("S", 2, 2)]


def test_a_tenth_of_the_ids_lost(spark):
    """Every message answers the one before; lost ids come back, so the result is that of the whole table."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    raw = spark.read.parquet("/root/testdata/sf0.01/chat_messages.parquet").withColumn("lost", F.pmod(F.xxhash64("message_id"), F.lit(10)) == 0)
    w = Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_first(), F.col("query").isNull(), "message_id")
    linked = raw.withColumn("reply_to", F.lag("message_id").over(w))
    want = kept(linked)
    assert len(want) > 1000 and linked.where("lost").count() > 150
    got = kept(linked.withColumn("session_id", F.when(~F.col("lost"), F.col("session_id"))), reply_to="reply_to")
    assert len(set(want) - set(got)) <= 0.01 * len(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201), (200, 202), (203, 202)]
    found = dict(components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect())
    assert {v for k, v in found.items() if k <= 40} == {1} and found[101] == 100 and {found.get(i) for i in (201, 202, 203)} == {200} and len(found) == 39 + 1 + 3
    assert components(spark.createDataFrame([], "x bigint, y bigint"), "x", "y").count() == 0
