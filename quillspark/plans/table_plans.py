"""Queries on keyed tables, sessions, feedback and events, and their SQL counterparts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import retrieval, sessions, tables
from quillspark.session import table
from quillspark.streaming import answers

#: Sub-queries of rows delivered once.
TURNS = "(SELECT DISTINCT ON (id) * FROM turns)"
CHUNKS = "(SELECT DISTINCT ON (id) * FROM chunks)"
LINKS = "(SELECT DISTINCT ON (id) * FROM links)"
FEEDBACK = "(SELECT * FROM feedback WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST) = 1)"
SPLIT = dt.datetime(2018, 1, 15)


def turns_of(spark, d):
    return table(spark, d, "turns").dropDuplicates(["id"])


def chunks_of(spark, d):
    return table(spark, d, "chunks").dropDuplicates(["id"])


def links_of(spark, d):
    return table(spark, d, "links").dropDuplicates(["id"])


def feedback_of(spark, d):
    return tables.newest(table(spark, d, "feedback"), "id", "updated_at", "created_at")


def chunk_scan(spark, d):
    return chunks_of(spark, d).where("model is not null").select("id", "chunk_id", "level", "model", "text_length")


def chunk_page(spark, d):
    return tables.page(chunks_of(spark, d).where("model is not null").select("id", "model"), "id", 100, 200)


def document_list(spark, d):
    return table(spark, d, "documents").select("doc_id", "title", "source", "created_at")


def newest_links(spark, d):
    rows = links_of(spark, d).where("source_file is not null")
    per_file = Window.partitionBy("source_file").orderBy(F.desc("created_at"), "id")
    return rows.select("id", "url", "source_file", F.row_number().over(per_file).alias("pos"))


def result_chunks(spark, d):
    """Point lookup of all chunks that results name."""
    keys = table(spark, d, "search_results").select(F.col("chunk_ref").alias("id"))
    return tables.lookup(chunks_of(spark, d), keys, "id").select("id", "file_id", "level")


def upserted_links(spark, d):
    rows = links_of(spark, d)
    old, new = rows.where(F.col("created_at") < F.lit(SPLIT)), rows.where(F.col("created_at") >= F.lit(SPLIT))
    return tables.upsert(old, new, "url").select("id", "url")


def inserted_links(spark, d):
    rows = links_of(spark, d).select("id", "url", "created_at")
    old, new = rows.where(F.col("created_at") < F.lit(SPLIT)), rows.where(F.col("created_at") >= F.lit(SPLIT))
    return tables.insert_absent(old, new.dropDuplicates(["url"]).select("url"), "url").groupBy("url").agg(F.count("*").alias("n"))


def chunks_without_results(spark, d):
    """Chunks that no result names: a delete by key."""
    keys = table(spark, d, "search_results").select(F.col("chunk_ref").alias("id"))
    return tables.delete(chunks_of(spark, d), keys, "id").select("id")


def pruned_turns(spark, d):
    return sessions.prune(turns_of(spark, d).select("id", "session_id", "ts"), 50).select("id", "session_id")


def recent_history(spark, d):
    return sessions.history(turns_of(spark, d).select("id", "session_id", "ts", "query"), 5).select("id", "session_id", "pos")


def first_turns(spark, d):
    return sessions.first_turns(turns_of(spark, d).select("id", "session_id", "ts"), 100).select("id", "session_id", "pos")


def session_list(spark, d):
    return sessions.session_list(turns_of(spark, d).select("id", "session_id", "ts", "query"), 500)


def session_totals(spark, d):
    return turns_of(spark, d).groupBy("session_id").agg(F.count("*").alias("turns"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def kept_turns(spark, d):
    return sessions.without_old(turns_of(spark, d).select("id", "ts"), SPLIT)


def pending_feedback(spark, d):
    return sessions.feedback_list(feedback_of(spark, d), "pending", 100).select("id", "created_at")


def feedback_status(spark, d):
    """All pending records become reviewed."""
    return sessions.set_status(feedback_of(spark, d), F.lower("status") == "pending", "reviewed").select("id", "status")


def feedback_cases(spark, d):
    return sessions.evaluation_cases(feedback_of(spark, d))


def feedback_evaluation(spark, d):
    row = sessions.evaluate(sessions.evaluation_cases(feedback_of(spark, d)))
    return row.select("cases", *(F.round(c, 6).alias(c) for c in ("grounded_rate", "coverage", "score")), "passed")


def reply_rate(spark, d):
    """Share of turns with a visible answer."""
    rows = turns_of(spark, d).select(F.coalesce(F.trim("answer") != "", F.lit(False)).alias("answered"))
    return sessions.pass_rate(rows, "answered").select("total", "passed", F.round("rate", 6).alias("rate"), "ok")


CASES_SQL = f"""SELECT 'feedback-' || id AS id, s >= 0.6 AS grounded, CASE WHEN coalesce(correction_text, '') <> '' THEN 0.9 WHEN s >= 0.6 THEN 0.7 ELSE 0.3 END::DOUBLE AS coverage, greatest(0.0, least(1.0, s))::DOUBLE AS score
  FROM (SELECT *, coalesce(score / 5.0, 0.5)::DOUBLE AS s FROM {FEEDBACK} WHERE lower(status) = 'approved')"""


def score_histograms(spark, d):
    """Histogram of the shown scores of every query."""
    found = sessions.histogram(table(spark, d, "search_results"), "query_id", "hybrid_score")
    return found.select("query_id", "n", *(F.round(c, 9).alias(c) for c in ("min", "max", "mean", "median", "p75")), *(F.col("counts")[i].alias(f"bin{i}") for i in range(5)))


HISTOGRAM_SQL = """WITH v AS (SELECT query_id, hybrid_score AS s FROM search_results WHERE hybrid_score IS NOT NULL AND isfinite(hybrid_score)),
  g AS (SELECT query_id, count(*) AS n, min(s) AS lo, max(s) AS hi, avg(s) AS mean, list(s ORDER BY s) AS l FROM v GROUP BY query_id),
  b AS (SELECT query_id, least(4, floor((s - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 5))::INT AS bin FROM v JOIN g USING (query_id)),
  c AS (SELECT query_id, count(*) FILTER (bin = 0) AS bin0, count(*) FILTER (bin = 1) AS bin1, count(*) FILTER (bin = 2) AS bin2, count(*) FILTER (bin = 3) AS bin3, count(*) FILTER (bin = 4) AS bin4 FROM b GROUP BY query_id)
  SELECT query_id, n, round(lo, 9) AS min, round(hi, 9) AS max, round(mean, 9) AS mean, round(l[floor(n * 0.5)::INT + 1], 9) AS median, round(l[floor(n * 0.75)::INT + 1], 9) AS p75, bin0, bin1, bin2, bin3, bin4 FROM g JOIN c USING (query_id)"""

FILTERS = [{"field": "level", "value": 0, "operator": "ne"}, {"field": "text_length", "value": 200, "operator": "gte"}, {"field": "lang", "value": ["en", "uk", None], "operator": "in"}, {"field": "model", "value": None}, {"field": "text_length", "value": "x", "operator": "lt"}]


def filtered_chunks(spark, d):
    return chunks_of(spark, d).where(tables.metadata_filter(FILTERS)).select("id", "level", "text_length", "lang")


def leaf_chunks(spark, d):
    """Children and chunks of flat strategies of a least length."""
    rows = table(spark, d, "chunks").where(tables.not_parent() & (F.col("text_length") >= 80))
    return rows.select("id", "level", "text_length").distinct()


def meaningful_results(spark, d):
    rows = table(spark, d, "search_results").where("text is not null")
    return tables.keep_or_all(rows, tables.meaningful(F.col("text"), 400), "query_id").select("result_id", "query_id")


MEANINGFUL_SQL = r"""WITH k AS (SELECT result_id, query_id, (length(trim(text, ' ')) >= 400 OR regexp_matches(text, 'https?://\S+|\b[\w-]+\.[\w.-]+\.\w{2,}\b')) AND NOT regexp_matches(trim(text, ' '), '^\[[^\]]{2,60}\][\s\\]*$') AS keep FROM search_results WHERE text IS NOT NULL),
  w AS (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS kept_any FROM k) SELECT result_id, query_id FROM w WHERE keep OR NOT kept_any"""


def strong_results(spark, d):
    """Results above the query's own threshold (none: all) and above the floor of their mode."""
    asked = table(spark, d, "vector_queries").select("query_id", "score_threshold", "search_mode")
    mode = F.lower(F.coalesce("search_mode", F.lit("balanced")))
    floor = F.when(mode == "precise", 0.75).when(mode == "wide", 0.5).otherwise(0.65)
    rows = table(spark, d, "search_results").join(asked, "query_id")
    return rows.where((F.col("vector_score") >= floor) & (F.col("score_threshold").isNull() | (F.col("hybrid_score") >= F.col("score_threshold")))).select("result_id", "query_id")


STRONG_SQL = """SELECT result_id, query_id FROM search_results JOIN vector_queries USING (query_id) WHERE vector_score >= CASE lower(coalesce(search_mode, 'balanced')) WHEN 'precise' THEN 0.75 WHEN 'wide' THEN 0.5 ELSE 0.65 END
  AND (score_threshold IS NULL OR hybrid_score >= score_threshold)"""


def factual_results(spark, d):
    """For surely factual queries (three of four) results of at least 0.6, or the best three of a query that has none; for the others all."""
    rows = table(spark, d, "search_results")
    return retrieval.strong(rows, "query_id", "result_id", "hybrid_score", 0.6, F.col("query_id") % 4 != 3).select("result_id", "query_id")


FACTUAL_SQL = """WITH w AS (SELECT result_id, query_id, hybrid_score, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC NULLS LAST, result_id) AS n, bool_or(coalesce(hybrid_score >= 0.6, false)) OVER (PARTITION BY query_id) AS kept_any FROM search_results)
  SELECT result_id, query_id FROM w WHERE query_id % 4 = 3 OR CASE WHEN kept_any THEN hybrid_score >= 0.6 ELSE n <= 3 END"""


def context_documents(spark, d):
    rows = table(spark, d, "search_results").where("text is not null")
    return tables.distinct_context(rows, "text", [F.col("hybrid_score").desc_nulls_last(), F.col("result_id")], 7, "query_id").select("result_id", "query_id")


CONTEXT_SQL = r"""WITH f AS (SELECT result_id, query_id, hybrid_score, left(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' '), 260) AS form FROM search_results WHERE text IS NOT NULL),
  o AS (SELECT * FROM f WHERE form <> '' QUALIFY row_number() OVER (PARTITION BY query_id, form ORDER BY hybrid_score DESC NULLS LAST, result_id) = 1)
  SELECT result_id, query_id FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC NULLS LAST, result_id) <= 7"""


def children_of_parents(spark, d):
    """Two-level chunk tree: each parent with the number of its children, listed and found."""
    rows = chunks_of(spark, d)
    kids = rows.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("found"))
    return rows.where("level = 0 and chunk_id is not null").select("id", "chunk_id", F.coalesce(F.size("child_ids"), F.lit(0)).alias("listed")).join(kids, F.col("chunk_id") == F.col("parent_id"), "left").select("id", "chunk_id", "listed", F.coalesce("found", F.lit(0)).alias("found"))


CHILDREN_SQL = f"""SELECT p.id, p.chunk_id, coalesce(len(p.child_ids), 0) AS listed, coalesce(k.found, 0) AS found FROM (SELECT * FROM {CHUNKS} WHERE level = 0 AND chunk_id IS NOT NULL) p
  LEFT JOIN (SELECT parent_id, count(*) AS found FROM {CHUNKS} WHERE parent_id IS NOT NULL GROUP BY parent_id) k ON p.chunk_id = k.parent_id"""


def answer_events(spark, d):
    rows = turns_of(spark, d).select("id", "answer")
    return answers.events(rows, "id", "answer").select("id", "seq", "event", F.when(F.col("event") == "token", F.col("payload")).alias("token"))


_SANE = "trim(regexp_replace(regexp_replace(regexp_replace(answer, '(?is)<linksResult>.*?</linksResult>|<linkResults>.*?</linkResults>|<links_usage_rules>.*?</links_usage_rules>', '', 'g'), '(?i)</?(linksResult|linkResults|links_usage_rules)>', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')"
EVENTS_SQL = f"""WITH t AS (SELECT id, coalesce(regexp_extract_all({_SANE}, '\\s*\\S+'), []) AS l FROM {TURNS})
  SELECT id, 0 AS seq, 'metadata' AS event, NULL AS token FROM t UNION ALL SELECT id, len(l) + 1, 'done', NULL FROM t UNION ALL SELECT id, generate_subscripts(l, 1), 'token', unnest(l) FROM t"""


def event_windows(spark, d):
    return answers.windowed(table(spark, d, "events"), "ts", "event_type", "value").select("window_start", "event_type", "events", F.round("total", 4).alias("total"))


def user_sessions(spark, d):
    return answers.sessions(table(spark, d, "events"), "ts", "user_id")


USER_SESSIONS_SQL = """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM g GROUP BY user_id, s"""

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in [
        (chunk_scan, f"SELECT id, chunk_id, level, model, text_length FROM {CHUNKS} WHERE model IS NOT NULL"), (chunk_page, f"SELECT id, model FROM {CHUNKS} WHERE model IS NOT NULL ORDER BY id LIMIT 100 OFFSET 200"),
        (document_list, "SELECT doc_id, title, source, created_at FROM documents"), (newest_links, f"SELECT id, url, source_file, row_number() OVER (PARTITION BY source_file ORDER BY created_at DESC, id) AS pos FROM {LINKS} WHERE source_file IS NOT NULL"),
        (result_chunks, f"SELECT id, file_id, level FROM {CHUNKS} WHERE id IN (SELECT chunk_ref FROM search_results)"),
        (upserted_links, f"WITH l AS {LINKS} SELECT id, url FROM l WHERE created_at >= '2018-01-15' OR (created_at < '2018-01-15' AND (url IS NULL OR url NOT IN (SELECT url FROM l WHERE created_at >= '2018-01-15' AND url IS NOT NULL)))"),
        (inserted_links, f"WITH l AS {LINKS}, o AS (SELECT url FROM l WHERE created_at < '2018-01-15'), n AS (SELECT DISTINCT url FROM l WHERE created_at >= '2018-01-15' AND url NOT IN (SELECT url FROM o WHERE url IS NOT NULL)) SELECT url, count(*) AS n FROM (SELECT url FROM o UNION ALL SELECT url FROM n) GROUP BY url"),
        (chunks_without_results, f"SELECT id FROM {CHUNKS} WHERE id NOT IN (SELECT chunk_ref FROM search_results WHERE chunk_ref IS NOT NULL)"),
        (pruned_turns, f"SELECT id, session_id FROM {TURNS} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC NULLS LAST, id DESC) <= 50"),
        (recent_history, f"WITH r AS (SELECT * FROM {TURNS} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC NULLS LAST, id DESC) <= 5) SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, id) AS pos FROM r"),
        (first_turns, f"SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, id) AS pos FROM {TURNS} QUALIFY pos <= 100"),
        (session_list, f"WITH r AS (SELECT * FROM {TURNS} ORDER BY ts DESC NULLS LAST, id DESC LIMIT 500), g AS (SELECT session_id, arg_max_null(query, (ts, id)) AS q, max(ts) AS last_activity, count(*) AS turn_count FROM r GROUP BY session_id) SELECT session_id, left(q, 60) || CASE WHEN length(q) > 60 THEN '…' ELSE '' END AS first_message, last_activity, turn_count FROM g"),
        (session_totals, f"SELECT session_id, count(*) AS turns, min(ts) AS first_ts, max(ts) AS last_ts FROM {TURNS} GROUP BY session_id"), (kept_turns, f"SELECT id, ts FROM {TURNS} WHERE ts IS NULL OR ts > '2018-01-15'"),
        (pending_feedback, f"SELECT id, created_at FROM {FEEDBACK} WHERE lower(status) = 'pending' ORDER BY created_at DESC NULLS LAST, id LIMIT 100"), (feedback_status, f"SELECT id, CASE WHEN lower(status) = 'pending' THEN 'reviewed' ELSE status END AS status FROM {FEEDBACK}"),
        (feedback_cases, CASES_SQL), (feedback_evaluation, f"SELECT count(*) AS cases, round(avg(grounded::INT), 6) AS grounded_rate, round(avg(coverage), 6) AS coverage, round(avg(score), 6) AS score, avg(grounded::INT) >= 0.72 AND avg(coverage) >= 0.55 AND avg(score) >= 0.58 AS passed FROM ({CASES_SQL})"),
        (reply_rate, f"SELECT count(*) AS total, count(*) FILTER (a) AS passed, round(count(*) FILTER (a) / count(*), 6) AS rate, count(*) FILTER (a) / count(*) >= 0.6 AS ok FROM (SELECT coalesce(trim(answer, ' ') <> '', false) AS a FROM {TURNS})"),
        (score_histograms, HISTOGRAM_SQL), (filtered_chunks, f"SELECT id, level, text_length, lang FROM {CHUNKS} WHERE level IS DISTINCT FROM 0 AND text_length >= 200 AND lang IN ('en', 'uk')"),
        (leaf_chunks, "SELECT DISTINCT id, level, text_length FROM chunks WHERE level IS DISTINCT FROM 0 AND text_length >= 80"), (meaningful_results, MEANINGFUL_SQL), (strong_results, STRONG_SQL), (factual_results, FACTUAL_SQL), (context_documents, CONTEXT_SQL),
        (children_of_parents, CHILDREN_SQL), (answer_events, EVENTS_SQL), (event_windows, "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"), (user_sessions, USER_SESSIONS_SQL),
    ]
}
