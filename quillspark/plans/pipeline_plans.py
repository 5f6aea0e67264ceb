"""Queries on what surrounds a search: variants of questions, reranking, links for answers, model ports, streams, and their SQL counterparts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import names, scoring, vectors
from quillspark.functions import text as T
from quillspark.functions.fixed import ABBREVIATIONS, LINK_STOP, QUERY_STOP, TO_LATIN
from quillspark.operators import answers as A
from quillspark.operators import cache, graph, links, models, querying, reranking, retrieval, sessions, tables
from quillspark.plans import chunk_sql, ingest
from quillspark.plans.search_plans import GRAPH, USABLE, _cosine_sql, _graph
from quillspark.plans.table_plans import CHUNKS, FEEDBACK, LINKS, TURNS, chunks_of, feedback_of, links_of, turns_of
from quillspark.plans.text_plans import LETTERS, LINK_WISHES, letter_counts, lit, names_sql
from quillspark.session import table
from quillspark.streaming import answers as S

NOW = dt.datetime(2018, 2, 1)
#: A chunk that letter_counts gives a vector.
HAS_LETTERS = "regexp_matches(chunk, '[" + LETTERS + "]')"


def question_variants(spark, d):
    """What is searched for each question; a model's answers are made of the question, and fail for some."""
    rows = turns_of(spark, d).where("query is not null").select("id", F.trim(F.regexp_replace("query", r"\s+", " ")).alias("query"), F.pmod(F.length("query"), F.lit(3)).alias("k"))
    q, entity = F.col("query"), F.col("k") == 0
    said = F.when(F.col("k") != 2, F.concat(q, F.lit("\n about "), q, F.lit("\n\nmore on "), q, F.lit("\nall of "), q))
    told = F.when(F.col("k") != 2, F.concat(F.lit("Plan, Report ,, "), F.left(q, F.lit(3))))
    base = T.query_keywords(q)
    rows = rows.withColumns({"expanded": querying.expanded(q, entity, said, QUERY_STOP), "rephrased": querying.rephrased(q, entity, said), "words": querying.keywords(q, F.lit(False), base, told)})
    found = querying.variants(q, F.col("expanded"), F.col("rephrased"), F.array(F.lit("переклад")), F.array(F.concat(F.lit("before: "), q)))
    return rows.select("id", *(F.array_join(c, "|").alias(n) for n, c in (("expanded", F.col("expanded")), ("rephrased", F.col("rephrased")), ("keywords", F.col("words")), ("variants", found))))


def _variants_sql() -> str:
    latin = "lower(c)"
    for a, b in TO_LATIN.items():
        latin = f"replace({latin}, '{a}', '{b}')"
    stop = ", ".join(map(lit, QUERY_STOP))
    once = lambda x: f"(SELECT list_filter(z, lambda e, i: list_position(z, e) = i) FROM (SELECT {x} AS z))"
    return rf"""WITH t AS (SELECT id, trim(regexp_replace(query, '\s+', ' ', 'g'), ' ') AS q, length(query) % 3 AS k FROM {TURNS} WHERE query IS NOT NULL),
  w AS (SELECT *, string_split(q, ' ') AS l FROM t), n AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '^[А-ЯІЇЄҐA-Z]') AND lower(x) NOT IN ({stop})) AS named,
    array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^[А-ЯІЇЄҐ]') AND length(regexp_replace(x, '[^а-яіїєґёэъыА-ЯІЇЄҐ]', '', 'g')) > 2 THEN upper(left({latin.replace("lower(c)", "lower(regexp_replace(x, '[^а-яіїєґёэъыА-ЯІЇЄҐ]', '', 'g'))")}, 1)) || substr({latin.replace("lower(c)", "lower(regexp_replace(x, '[^а-яіїєґёэъыА-ЯІЇЄҐ]', '', 'g'))")}, 2) ELSE x END), ' ') AS latin FROM w),
  m AS (SELECT *, CASE WHEN k <> 2 THEN list_filter(['about ' || q, 'more on ' || q, 'all of ' || q], lambda x: x <> q) ELSE [] END AS said FROM n),
  e AS (SELECT *, CASE WHEN k = 0 THEN {once("list_concat(CASE WHEN latin <> q THEN [latin] ELSE [] END, CASE WHEN len(named) > 1 THEN [named[-1], named[1]] ELSE [] END)")}[1:4] ELSE said[1:3] END AS e, CASE WHEN k <> 0 AND len(l) > 4 THEN said ELSE [] END AS r,
    {once(f"list_filter(regexp_split_to_array(regexp_replace(lower(q), '[?!.,;:''\"]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({stop}))")}[1:15] AS base FROM m),
  v AS (SELECT *, list_filter(CASE WHEN len(l) <= 3 THEN list_concat([q], e[1:1]) ELSE list_concat([q], e[1:2], r[1:1])[1:4] END, lambda x: x <> '') AS own FROM e)
  SELECT id, array_to_string(e, '|') AS expanded, array_to_string(r, '|') AS rephrased, array_to_string(CASE WHEN k = 2 THEN base[1:10] ELSE {once("list_concat(base, list_filter(list_transform(string_split('plan, report ,, ' || lower(left(q, 3)), ','), lambda x: trim(x, ' ')), lambda x: x <> ''))")}[1:20] END, '|') AS keywords,
    array_to_string({once("list_concat(" + once("list_concat(own, ['переклад'])") + "[1:6], ['before: ' || q])")}[1:6], '|') AS variants FROM v"""


_STRATEGIES = ["none", "cross_encoder", "llm_based", "hybrid", "listwise_llm"]


def reranked_results(spark, d):
    """Each result list reranked by a strategy of its own, where it is long enough; the floor behind it."""
    rows = table(spark, d, "search_results").select("query_id", "result_id", F.coalesce("hybrid_score", F.lit(0.0)).alias("score"), F.coalesce("vector_score", F.lit(0.0)).alias("v"), F.coalesce("keyword_score", F.lit(0.0)).alias("k"))
    strategy = F.element_at(F.array(*map(F.lit, _STRATEGIES)), (F.col("query_id") % 5 + 1).cast("int"))
    mode = F.when(F.col("query_id") % 2 == 0, "entity").otherwise("balanced")
    finals = {"listwise": F.col("v") / 2, "llm": A.pointwise(F.col("score"), F.concat(F.lit(" "), F.round("k", 1)))[1], "hybrid": A.hybrid_rerank(F.col("score"), F.col("v"))}
    found = reranking.rerank(rows, "query_id", "result_id", strategy, mode, F.lit(3), finals, F.col("query_id") % 7 != 0)
    return found.select("query_id", "result_id", "method", "reranked", F.round("score", 6).alias("score"), "rank")


RERANKED_SQL = f"""WITH r AS (SELECT query_id, result_id, coalesce(hybrid_score, 0) AS s, coalesce(vector_score, 0) AS v, coalesce(keyword_score, 0) AS k, count(*) OVER (PARTITION BY query_id) AS n,
    CASE WHEN query_id % 7 = 0 THEN 'none' ELSE ['none', 'listwise', 'llm', 'hybrid', 'listwise'][query_id % 5 + 1] END AS method FROM search_results),
  f AS (SELECT *, method <> 'none' AND n > 3 AS reranked, CASE WHEN method = 'none' OR n <= 3 THEN s WHEN method = 'listwise' THEN v / 2 WHEN method = 'llm' THEN round(k, 1) / 10 ELSE 0.3 * s + 0.7 * v END AS x FROM r),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, result_id) AS rank FROM f)
  SELECT query_id, result_id, method, reranked, round(x, 6) AS score, rank FROM o WHERE (NOT reranked OR rank <= CASE WHEN query_id % 2 = 0 THEN 24 ELSE 3 END) AND x > CASE WHEN method = 'none' THEN 0.01 ELSE 0.0163 END"""


def pointwise_scores(spark, d):
    """A model's number from 0 to 10 for each result, which is missing for some."""
    rows = table(spark, d, "search_results").select("query_id", "result_id", F.col("hybrid_score").alias("score"), F.when(F.col("pos") % 3 == 0, "no idea").otherwise(F.concat(F.lit(" "), F.col("pos") % 11, F.lit(".5 of 10"))).alias("said"))
    rerank, final = A.pointwise(F.col("score"), F.col("said"))
    return rows.select("query_id", "result_id", F.round(rerank, 6).alias("rerank_score"), F.round(final, 6).alias("final_score"))


POINTWISE_SQL = "SELECT query_id, result_id, round(coalesce(n, 0.5), 6) AS rerank_score, round(coalesce(n, hybrid_score, 0.5), 6) AS final_score FROM (SELECT *, CASE WHEN pos % 3 <> 0 THEN (pos % 11 + 0.5) / 10 END AS n FROM search_results)"


def _named(spark, d):
    """Results with the spelling groups of two words of the first result's text, as if a question named them."""
    rows = table(spark, d, "search_results").where("text is not null").select("query_id", "result_id", "text", F.coalesce("hybrid_score", F.lit(0.0)).alias("score"))
    words = F.filter(F.split(F.col("first"), r"[^a-zа-яіїєґA-ZА-ЯІЇЄҐ]+"), lambda w: F.length(w) > 6)
    first = rows.groupBy("query_id").agg(F.min_by("text", F.struct("score", "result_id")).alias("first")).select("query_id", F.slice(words, 1, 2).alias("words"))
    return rows.join(first, "query_id")


def name_ordered_results(spark, d):
    """Results by the number of names they hold, then by score; a name counts in any spelling."""
    rows = _named(spark, d).withColumn("groups", names.token_groups("words"))
    return reranking.by_names(rows, "query_id", "result_id", F.col("groups")).select("query_id", "result_id", "place", (F.col("matches") == F.size("groups")).alias("every"))


def entity_results(spark, d):
    """Results that hold all of two words of one of them, else the last, else the first three."""
    rows = _named(spark, d).withColumn("groups", F.transform("words", lambda w: F.array(F.lower(w))))
    found = retrieval.entity_filter(rows, F.col("groups"), "query_id", [F.desc("score"), F.col("result_id")], 3)
    return found.select("query_id", "result_id", "fallback")


def _latin(x: str) -> str:
    out = f"lower({x})"
    for a, b in TO_LATIN.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


NAME_ORDER_SQL = f"""WITH r AS (SELECT query_id, result_id, text, coalesce(hybrid_score, 0) AS score FROM search_results WHERE text IS NOT NULL), f AS (SELECT query_id, arg_min(text, (score, result_id)) AS t FROM r GROUP BY query_id),
  w AS (SELECT query_id, list_filter(regexp_split_to_array(t, '[^a-zа-яіїєґA-ZА-ЯІЇЄҐ]+'), lambda x: length(x) > 6)[1:2] AS g FROM f), n AS (SELECT query_id, unnest(g) AS t, generate_subscripts(g, 1) AS i FROM w),
  o AS (SELECT query_id, i, regexp_replace(lower(t), '[^a-zа-яіїєґё]', '', 'g') AS o FROM n), {names_sql('query_id, i')},
  m AS (SELECT query_id, result_id, count(DISTINCT i) AS m FROM r JOIN v USING (query_id) WHERE contains(lower(text), w) OR contains({_latin('text')}, w) GROUP BY ALL)
  SELECT query_id, result_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(m, 0) DESC, round(score, 9) DESC, result_id) AS place, coalesce(m, 0) = len(g) AS every FROM r JOIN w USING (query_id) LEFT JOIN m USING (query_id, result_id)"""
ENTITY_SQL = f"""WITH r AS (SELECT query_id, result_id, text, coalesce(hybrid_score, 0) AS score FROM search_results WHERE text IS NOT NULL), f AS (SELECT query_id, arg_min(text, (score, result_id)) AS t FROM r GROUP BY query_id),
  w AS (SELECT query_id, list_transform(list_filter(regexp_split_to_array(t, '[^a-zа-яіїєґA-ZА-ЯІЇЄҐ]+'), lambda x: length(x) > 6)[1:2], lambda x: lower(x)) AS g FROM f),
  h AS (SELECT query_id, result_id, score, list_transform(g, lambda x: contains(lower(text), x) OR contains({_latin('text')}, x)) AS h FROM r JOIN w USING (query_id)),
  e AS (SELECT *, len(list_filter(h, lambda x: NOT x)) = 0 AS every, coalesce(h[-1], false) AS last, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_id) AS n FROM h),
  a AS (SELECT *, bool_or(every) OVER (PARTITION BY query_id) AS any_every, bool_or(last) OVER (PARTITION BY query_id) AS any_last FROM e)
  SELECT query_id, result_id, NOT any_every AND NOT any_last AS fallback FROM a WHERE CASE WHEN any_every THEN every WHEN any_last THEN last ELSE n <= 3 END"""


def _questions(spark, d):
    """A question for each reference term: its label, asked for as a link or not."""
    terms = table(spark, d, "canon_terms").where("kind <> 'query'")
    return terms.select(F.col("term_id").alias("query_id"), F.concat(F.when(F.col("term_id") % 2 == 0, "Which link is about ").otherwise("Tell me more of "), "term", F.lit("?")).alias("query"))


def links_for_questions(spark, d):
    """Links for questions that ask for one, of four points at least, as a block."""
    found = links.find(links_of(spark, d), _questions(spark, d), 4, LINK_WISHES)
    return found.select("query_id", "found", "links", F.md5(F.coalesce("block", F.lit("")).cast("binary")).alias("digest"))


def links_for_context(spark, d):
    """Links for any question, as a block."""
    found = links.find(links_of(spark, d), _questions(spark, d), 0)
    return found.select("query_id", "found", "links", F.md5(F.coalesce("block", F.lit("")).cast("binary")).alias("digest"))


def _links_sql(least: int, wishes: bool) -> str:
    known = "MAP {" + ", ".join(f"{lit(k)}: [{', '.join(map(lit, v))}]" for k, v in ABBREVIATIONS.items()) + "}"
    asks = f"regexp_matches(lower(q), {lit('(?i)' + '|'.join(LINK_WISHES))})" if wishes else "true"
    return rf"""WITH q AS (SELECT term_id AS query_id, CASE WHEN term_id % 2 = 0 THEN 'Which link is about ' ELSE 'Tell me more of ' END || term || '?' AS q FROM canon_terms WHERE kind <> 'query'),
  w AS (SELECT query_id, q, {asks} AS asks, list_filter(regexp_split_to_array(regexp_replace(lower(q), '[?!.,;:''"()\[\]]', '', 'g'), '\s+'), lambda x: length(x) > 1 AND x NOT IN ({', '.join(map(lit, LINK_STOP))})) AS l FROM q),
  k AS (SELECT query_id, q, asks, list_distinct(flatten(list_transform(l, lambda x: list_concat([x], coalesce({known}[x], []))))) AS ks FROM w), a AS (SELECT query_id, unnest(ks) AS w FROM k WHERE asks), l AS {LINKS},
  h AS (SELECT query_id, id, url, created_at, max(CASE WHEN list_contains(keywords, w) THEN 2 ELSE 0 END) + max(CASE WHEN contains(lower(label), w) THEN 1 ELSE 0 END) + max(CASE WHEN contains(lower(context), w) THEN 1 ELSE 0 END) + max(CASE WHEN contains(lower(source_file), w) THEN 1 ELSE 0 END) AS relevance FROM a, l GROUP BY ALL),
  o AS (SELECT * FROM h WHERE relevance > 0 QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY relevance DESC, created_at DESC, id) = 1),
  u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY url) <= 30), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, url) AS rank FROM u),
  p AS (SELECT n.query_id, rank, l.url, coalesce(label, '') AS label, CASE WHEN label <> '' AND contains(lower(q), lower(label)) THEN 10 ELSE 0 END + coalesce(list_sum(list_transform(ks, lambda k: CASE WHEN len(list_filter(coalesce(keywords, []), lambda o: starts_with(o, k))) > 0 THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(label, '')), k) THEN 2 ELSE 0 END
      + CASE WHEN contains(lower(coalesce(context, '')), k) THEN 1 ELSE 0 END + CASE WHEN contains(lower(coalesce(source_file, '')), k) THEN 1 ELSE 0 END)), 0) + CASE WHEN link_type = 'image' AND regexp_matches(lower(q), 'фото|image|photo|зображ|скрин') OR link_type = 'video' AND regexp_matches(lower(q), 'відео|video|запис') THEN 5 ELSE 0 END AS points
      FROM n JOIN l USING (id) JOIN k ON k.query_id = n.query_id WHERE regexp_matches(l.url, '^https?://') AND contains(regexp_extract(l.url, '^https?://([^/?#:]+)', 1), '.')),
  g AS (SELECT query_id, count(*) AS n, string_agg(label || '**: ' || url, chr(10) ORDER BY points DESC, rank) AS b FROM p WHERE points >= {least} GROUP BY query_id)
  SELECT k.query_id, {'asks' if wishes else 'n IS NOT NULL'} AS found, coalesce(n, 0) AS links, md5(coalesce(b, '')) AS digest FROM k LEFT JOIN g USING (query_id)"""


def reindexed_links(spark, d):
    """The links of files that were read again replaced by the newer ones."""
    rows = links_of(spark, d).select("id", "url", "source_file", "created_at")
    old, new = rows.where(F.col("created_at") < F.lit(dt.datetime(2018, 1, 15))), rows.where(F.col("created_at") >= F.lit(dt.datetime(2018, 1, 15)))
    return links.reindexed(old, new).select("id", "source_file")


REINDEXED_SQL = f"WITH l AS {LINKS}, n AS (SELECT * FROM l WHERE created_at >= '2018-01-15') SELECT id, source_file FROM l WHERE created_at < '2018-01-15' AND (source_file IS NULL OR source_file NOT IN (SELECT source_file FROM n WHERE source_file IS NOT NULL)) UNION ALL SELECT id, source_file FROM n"


def compressed_contexts(spark, d):
    """Texts of results cut for their query's keywords: an extract, a model's words where that is too long, the whole text for names."""
    rows = table(spark, d, "search_results").where("text is not null").select("result_id", "text", F.lit("team report plan must").alias("query"), F.when(F.col("query_id") % 3 > 0, F.concat(F.lit("In short: "), F.left("text", F.lit(20)))).alias("said"), F.when(F.col("query_id") % 5 == 0, "entity").otherwise("wide").alias("mode"))
    return A.compress_hybrid(rows, ["result_id"], "query", "text", "said", "mode", 20).select("result_id", F.md5(F.col("compressed").cast("binary")).alias("digest"))


COMPRESSED_SQL = """WITH t AS (SELECT result_id, query_id, text, CASE WHEN len(regexp_extract_all(text, '[^.!?]+[.!?]+')) > 0 THEN regexp_extract_all(text, '[^.!?]+[.!?]+') ELSE [text] END AS l FROM search_results WHERE text IS NOT NULL),
  s AS (SELECT result_id, query_id, text, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM t),
  m AS (SELECT *, len(list_filter(regexp_split_to_array(regexp_replace(lower(s), '[^a-zа-яіїєґ\\s]', '', 'g'), '\\s+'), lambda w: w IN ('team', 'report', 'plan', 'must'))) AS m, len(regexp_split_to_array(s, '\\s+')) AS n FROM s),
  o AS (SELECT *, row_number() OVER w AS r, sum(n) OVER w AS upto FROM m WINDOW w AS (PARTITION BY result_id ORDER BY m DESC, i ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT result_id, query_id, text, coalesce(string_agg(s, ' ' ORDER BY r) FILTER (r <= 15 AND upto <= 30), '') AS c FROM o GROUP BY ALL),
  c AS (SELECT *, CASE WHEN length(c) > 80 THEN CASE WHEN query_id % 3 > 0 THEN 'In short: ' || left(text, 20) END ELSE c END AS z FROM k)
  SELECT result_id, md5(CASE WHEN query_id % 5 = 0 OR coalesce(z, '') = '' THEN text ELSE z END) AS digest FROM c"""


def _letters(text):
    """How often each of LETTERS occurs, as a vector that SQL can have as well."""
    return F.array(*((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in LETTERS))


def similar_sentences(spark, d):
    """The sentences of results nearest to a question by letters, of those that share most words with it."""
    rows = table(spark, d, "search_results").where("text is not null").withColumn("query", F.lit("team leads must confirm the travel report"))
    found = A.compress(rows, ["result_id"], "query", "text", 40, 5, lambda s: vectors.cosine(_letters(F.col("__query")), _letters(s)))
    return found.select("result_id", F.md5(F.col("compressed").cast("binary")).alias("digest"))


def _similar_sql() -> str:
    counts = lambda x: "[" + ", ".join(f"(length({x}) - length(replace({x}, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"
    return rf"""WITH t AS (SELECT result_id, text, CASE WHEN len(regexp_extract_all(text, '[^.!?]+[.!?]+')) > 0 THEN regexp_extract_all(text, '[^.!?]+[.!?]+') ELSE [text] END AS l, {counts("'team leads must confirm the travel report'")} AS q FROM search_results WHERE text IS NOT NULL),
  s AS (SELECT result_id, q, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM t),
  m AS (SELECT *, len(list_filter(regexp_split_to_array(regexp_replace(lower(s), '[^a-zа-яіїєґ\s]', '', 'g'), '\s+'), lambda w: w IN ('team', 'leads', 'must', 'confirm', 'the', 'travel', 'report'))) AS m, len(regexp_split_to_array(s, '\s+')) AS n, {counts('s')} AS v FROM s),
  c AS (SELECT *, round(CASE WHEN list_sum(v) = 0 THEN 0 ELSE list_cosine_similarity(q, v) END, 9) AS d FROM m QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY m DESC, i) <= 5),
  o AS (SELECT *, sum(n) OVER (PARTITION BY result_id ORDER BY d DESC, i ROWS UNBOUNDED PRECEDING) AS upto FROM c)
  SELECT result_id, md5(coalesce(string_agg(s, ' ' ORDER BY d DESC, i) FILTER (upto <= 40), '')) AS digest FROM o GROUP BY result_id"""


def _first_model(prompts):
    """Fails for a batch with a long prompt, and knows nothing of some."""
    if any(len(p) > 400 for p in prompts):
        raise RuntimeError("too long")
    return [None if len(p) % 7 == 0 else f"Plan, {p[:5]}, report" for p in prompts]


def _second_model(prompts):
    if any(len(p) > 3000 for p in prompts):
        raise RuntimeError("too long")
    return [f"other,{p[-8:]}" for p in prompts]


def model_keywords(spark, d):
    """Keywords of each chunk by a model, by a second one where that fails, by frequency where both do."""
    rows = chunks_of(spark, d).where("text is not null")
    said = models.completed(F.col("text"), models.routed(_first_model, _second_model))
    return rows.select("id", F.array_join(models.model_keywords(said, F.col("text")), "|").alias("keywords"))


MODEL_KEYWORDS_SQL = f"""WITH c AS (SELECT id, text, CASE WHEN length(text) <= 400 AND length(text) % 7 <> 0 THEN 'Plan, ' || left(text, 5) || ', report' WHEN length(text) <= 3000 THEN 'other,' || right(text, 8) END AS said FROM {CHUNKS} WHERE text IS NOT NULL),
  s AS (SELECT id, list_filter(list_transform(regexp_split_to_array(coalesce(said, ''), '[,\\n]'), lambda w: lower(trim(w, ' '))), lambda w: length(w) BETWEEN 3 AND 29) AS l FROM c),
  fw AS (SELECT id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word, generate_subscripts(regexp_split_to_array(lower(text), '\\s+'), 1) AS pos FROM c), fc AS (SELECT id, word, count(*) AS n, min(pos) AS first FROM fw WHERE length(word) > 4 AND word NOT IN ('який', 'якщо', 'також', 'this', 'that', 'which') GROUP BY ALL),
  f AS (SELECT id, string_agg(word, '|' ORDER BY n DESC, first) AS k FROM (SELECT * FROM fc QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, first) <= 15) GROUP BY id)
  SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:20], '|') ELSE coalesce(k, '') END AS keywords FROM s LEFT JOIN f USING (id)"""


def image_list(spark, d):
    """The first 1,000 images by id (links to files stand for them)."""
    return links_of(spark, d).where("lower(link_type) = 'file'").orderBy("id").limit(1000).select("id", "label", "url")


def _streams(spark, d):
    """Events of a first model that breaks off for some answers, and of a second one for all."""
    rows = turns_of(spark, d).where("answer is not null").select("id", "answer", (F.length("answer") % 4 == 0).alias("fails"))
    whole = S.events(rows, "id", "answer")
    first = whole.join(rows.select("id", "fails"), "id").where("not fails or seq <= 3").select("id", "seq", F.when(F.col("fails") & (F.col("seq") == 3), "error").otherwise(F.col("event")).alias("event"), "payload")
    return first, S.events(rows.select("id", F.concat(F.lit("Again: "), "answer").alias("answer")), "id", "answer")


def fallback_events(spark, d):
    """Streams of a first model, with a second one behind those that break off; then as frames."""
    first, second = _streams(spark, d)
    found = S.frames(S.with_fallback(first, second, "id"), "id")
    return found.select("id", "seq", F.md5(F.col("frame").cast("binary")).alias("digest"))


_SANE = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<linksResult>.*?</linksResult>|<linkResults>.*?</linkResults>|<links_usage_rules>.*?</links_usage_rules>', '', 'g'), '(?i)</?(linksResult|linkResults|links_usage_rules)>', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ')"
_EVENTS = f"""t AS (SELECT id, length(answer) % 4 = 0 AS fails, regexp_extract_all({_SANE.format('answer')}, '\\s*\\S+') AS a, regexp_extract_all({_SANE.format("'Again: ' || answer")}, '\\s*\\S+') AS b FROM {TURNS} WHERE answer IS NOT NULL),
  e1 AS (SELECT id, fails, 0 AS seq, 'metadata' AS event, '{{"key":"' || id || '"}}' AS payload, len(a) AS n FROM t UNION ALL SELECT id, fails, generate_subscripts(a, 1), 'token', unnest(a), len(a) FROM t UNION ALL SELECT id, fails, len(a) + 1, 'done', NULL, len(a) FROM t),
  e2 AS (SELECT id, generate_subscripts(b, 1) AS seq, 'token' AS event, unnest(b) AS payload FROM t UNION ALL SELECT id, len(b) + 1, 'done', NULL FROM t),
  k AS (SELECT id, seq, event, payload FROM e1 WHERE NOT fails OR seq < 3 UNION ALL SELECT e2.id, e2.seq + 3, e2.event, e2.payload FROM e2 JOIN (SELECT DISTINCT id FROM e1 WHERE fails AND seq = 3) USING (id)),
  o AS (SELECT *, coalesce(bool_or(event = 'done') OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM k)"""
FALLBACK_SQL = f"WITH {_EVENTS} SELECT id, seq, md5('event: ' || event || chr(10) || 'data: ' || coalesce(replace(payload, chr(10), chr(10) || 'data: '), '{{}}') || chr(10) || chr(10)) AS digest FROM o WHERE NOT over"


def settled_answers(spark, d):
    """Answers of complete streams that were found grounded, for the cache."""
    first, _ = _streams(spark, d)
    verdicts = turns_of(spark, d).select("id", (F.length("query") % 3 > 0).alias("grounded"))
    return S.settled(first, verdicts, "id").select("id", F.md5(F.col("answer").cast("binary")).alias("digest"))


SETTLED_SQL = f"WITH t AS (SELECT id, array_to_string(regexp_extract_all({_SANE.format('answer')}, '\\s*\\S+'), '') AS a FROM {TURNS} WHERE answer IS NOT NULL AND length(query) % 3 > 0 AND (length(answer) % 4 <> 0 OR len(regexp_extract_all({_SANE.format('answer')}, '\\s*\\S+')) < 2)) SELECT id, md5(a) AS digest FROM t WHERE a <> ''"


def cleared_turns(spark, d):
    """Turns without the sessions of one day."""
    rows = turns_of(spark, d)
    gone = rows.where(F.to_date("ts") == F.lit(dt.date(2018, 1, 10))).select("session_id")
    return sessions.cleared(rows, gone).select("id", "session_id")


CLEARED_SQL = f"SELECT id, session_id FROM {TURNS} WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM {TURNS} WHERE ts::DATE = '2018-01-10' AND session_id IS NOT NULL)"


def created_feedback(spark, d):
    """Feedback with a new record for each approved one."""
    rows = feedback_of(spark, d).select("id", "session_id", "status", "created_at", "updated_at")
    new = rows.where("lower(status) = 'approved'").select(F.concat(F.lit("new-"), "id").alias("id"), "session_id")
    return sessions.created(rows, new, NOW).select("id", "status", "created_at")


CREATED_SQL = f"SELECT id, status, created_at FROM {FEEDBACK} UNION ALL SELECT 'new-' || id, 'pending', TIMESTAMP '2018-02-01' FROM {FEEDBACK} WHERE lower(status) = 'approved'"


def session_number(spark, d):
    return sessions.session_count(turns_of(spark, d))


def chunks_without_files(spark, d):
    """Chunks without those of files that have options."""
    files = table(spark, d, "split_options").select("file_id").distinct()
    return tables.delete(chunks_of(spark, d).where("file_id is not null"), files, "file_id").select("id", "file_id")


def grounded_answers(spark, d):
    """Answers by the grounding policy: verified with what their session said before, else with their own question."""
    w = Window.partitionBy("session_id").orderBy(F.col("ts").asc_nulls_first(), "id")
    rows = turns_of(spark, d).withColumns({"sources": F.array(F.lag("answer").over(w)), "cites": F.array("query"), "s": (F.length("answer") % 10) / 10})
    tier = F.when(F.col("s") >= 0.8, "HIGH").when(F.col("s") < 0.3, "LOW").otherwise("GRAY_ZONE")
    grounded, verdict = A.verify(F.col("s"), tier, F.lit(0.7))
    made = A.grounded_answer(F.col("answer"), F.col("sources"), F.col("cites"), grounded, tier, verdict)
    return rows.select("id", F.size(A.verified_texts(F.col("sources"), F.col("cites"))).alias("texts"), F.md5(F.coalesce(made, F.lit("")).cast("binary")).alias("digest"))


GROUNDED_SQL = f"""WITH t AS (SELECT id, answer, query, lag(answer) OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, id) AS prev, (length(answer) % 10) / 10 AS s FROM {TURNS}),
  v AS (SELECT *, CASE WHEN coalesce(prev, '') <> '' OR coalesce(query, '') <> '' THEN 1 ELSE 0 END AS texts, s >= 0.8 OR (s >= 0.3 AND (s + 0.7) / 2 >= 0.65) AS ok FROM t)
  SELECT id, texts, md5(coalesce(CASE WHEN trim(coalesce(answer, ''), ' ') = '' OR texts = 0 OR ok THEN answer ELSE {lit(A.FALLBACK)} END, '')) AS digest FROM v"""


def repository_chunks(spark, d):
    """Nearest stored chunks with a model and enough text, of at least the wide mode's similarity."""
    found = retrieval.repository_nearest(chunks_of(spark, d), table(spark, d, "vector_queries"), 10, "wide")
    return found.select("query_id", "id", F.round("score", 5).alias("score"), "rank")


REPOSITORY_SQL = f"""WITH q AS (SELECT query_id, vector::DOUBLE[] AS v FROM vector_queries WHERE {USABLE.format('vector')}), b AS (SELECT id, embedding::DOUBLE[] AS e FROM {CHUNKS} WHERE level IS DISTINCT FROM 0 AND model IS NOT NULL AND length(trim(text, ' ')) >= 80 AND {USABLE.format('embedding')}),
  s AS (SELECT query_id, id, {_cosine_sql('v', 'e')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM q, b QUALIFY rank <= 10) SELECT query_id, id, round(score, 5) AS score, rank FROM s WHERE score >= 0.5"""


def approximate_recall(spark, d):
    """Approximate search of the turns against the exact one: for how many queries, and whether nine of ten neighbours at least are found."""
    base, asked = table(spark, d, "turns"), table(spark, d, "vector_queries")  # both searches take an id once
    usable = lambda c: F.exists(c, lambda x: x != 0)
    base, asked = base.where(usable("embedding")), asked.where(usable("vector"))
    true = retrieval.nearest(base, "id", "embedding", asked, "query_id", "vector", 10, 96).select("query_id", "id")
    found = retrieval.nearest_approximate(base, "id", "embedding", asked, "query_id", "vector", 10, 96).select("query_id", "id", F.lit(1).alias("hit"))
    return true.join(found, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("holds"))


RECALL_SQL = f"SELECT count(*) AS queries, true AS holds FROM vector_queries WHERE {USABLE.format('vector')} AND len(list_filter(vector, lambda x: x <> 0)) > 0"


def embedding_scores(spark, d):
    """Similarity of each result to its query by the chunk's vector, else by a stand-in made of the text."""
    rows = table(spark, d, "search_results").join(table(spark, d, "vector_queries").select("query_id", "vector"), "query_id").join(chunks_of(spark, d).select(F.col("id").alias("chunk_ref"), "embedding"), "chunk_ref", "left")
    rows = rows.where(vectors.valid(F.col("vector"), 96) & (F.col("embedding").isNull() | (F.size("embedding") == 0) | vectors.valid(F.col("embedding"), 96)))
    made = F.transform(F.sequence(F.lit(1), F.lit(96)), lambda i: (F.length("text") % (i + 1)).cast("double"))
    return rows.select("query_id", "result_id", F.round(A.embedding_rerank(F.col("vector"), F.col("embedding"), made), 5).alias("score"))


EMBEDDING_SQL = f"""WITH r AS (SELECT query_id, result_id, search_results.text AS text, vector::DOUBLE[] AS v, embedding::DOUBLE[] AS e FROM search_results JOIN vector_queries USING (query_id) LEFT JOIN {CHUNKS} c ON c.id = chunk_ref WHERE {USABLE.format('vector')} AND (embedding IS NULL OR len(embedding) = 0 OR ({USABLE.format('embedding')}))),
  m AS (SELECT *, CASE WHEN len(e) > 0 THEN e WHEN text IS NOT NULL THEN list_transform(range(1, 97), lambda i: (length(text) % (i + 1))::DOUBLE) END AS w FROM r) SELECT query_id, result_id, round(coalesce({_cosine_sql('v', 'w')}, 0), 5) AS score FROM m"""


def cached_answers(spark, d):
    """Answers of one day in the cache, asked for by the questions of all; then those of one group are invalidated."""
    rows = turns_of(spark, d).where("query is not null and answer is not null and lang is not null").select("id", "query", "answer", "ts", cache.key(F.col("query"), F.col("lang")).alias("key"))
    early = rows.where(F.col("ts") < F.lit(dt.datetime(2018, 1, 10)))
    best = early.groupBy("key").agg(F.min("answer").alias("value"))
    store = cache.put(spark.createDataFrame([], "key string, value string, expires_at timestamp"), best, NOW)
    got = cache.get(rows.select("id", "key", (F.length("query") % 5 == 0).alias("bypass")), store, NOW + dt.timedelta(seconds=100))
    late = cache.get(rows.select("id", "key"), store, NOW + dt.timedelta(seconds=200)).where("value is not null").count()
    gone = cache.invalidate(store, "answer:").count()
    return got.select("id", F.md5(F.coalesce("value", F.lit("")).cast("binary")).alias("digest"), F.lit(late).alias("late"), F.lit(gone).alias("left"))


CACHED_SQL = f"""WITH t AS (SELECT id, answer, ts, lang, length(query) % 5 = 0 AS bypass, left(trim(regexp_replace(lower(query), '\\s+', ' ', 'g'), ' '), 600) AS k FROM {TURNS} WHERE query IS NOT NULL AND answer IS NOT NULL AND lang IS NOT NULL),
  s AS (SELECT k, lang, min(answer) AS v FROM t WHERE ts < '2018-01-10' GROUP BY ALL) SELECT id, md5(CASE WHEN bypass THEN '' ELSE coalesce(v, '') END) AS digest, 0 AS late, 0 AS left FROM t LEFT JOIN s USING (k, lang)"""


def stream_deltas(spark, d):
    """What each answer adds to its first half, cleaned of markup, and nothing where it is no continuation of what was sent."""
    rows = turns_of(spark, d).where("answer is not null").select("id", "answer", F.when(F.length("answer") % 3 == 0, F.lit("other")).otherwise(T.sanitize_output(F.left("answer", F.floor(F.length("answer") / 2).cast("int")))).alias("sent"))
    return rows.select("id", F.md5(S.deltas(F.col("answer"), F.col("sent")).cast("binary")).alias("digest"))


DELTAS_SQL = f"WITH t AS (SELECT id, {_SANE.format('answer')} AS c, CASE WHEN length(answer) % 3 = 0 THEN 'other' ELSE {_SANE.format('left(answer, length(answer) // 2)')} END AS s FROM {TURNS} WHERE answer IS NOT NULL) SELECT id, md5(CASE WHEN starts_with(c, s) THEN substr(c, length(s) + 1) ELSE '' END) AS digest FROM t"


def relevance_scores(spark, d):
    """Numbers that a model's answers hold: here the rounded scores of results among words."""
    rows = table(spark, d, "search_results")
    said = F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" "), F.col("pos"), F.lit(",5 of it"))).when(F.col("pos") % 3 == 1, F.concat(F.lit("0."), F.col("pos"), F.lit(" is it"))).otherwise(F.lit("about 0.7"))
    return rows.select("result_id", F.round(scoring.parsed_relevance(said), 6).alias("relevance"))


RELEVANCE_SQL = "SELECT result_id, round(CASE WHEN pos % 3 = 0 THEN least(1, pos + 0.5) WHEN pos % 3 = 1 THEN ('0.' || pos)::DOUBLE ELSE 0 END, 6) AS relevance FROM search_results"


def coerced_vectors(spark, d):
    """Vectors out of what services answer: a list, an object, a list of objects, or something else."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    as_json = F.to_json(F.struct(F.col("v").alias("embedding")))
    raw = F.when(F.col("vec_id") % 4 == 0, F.to_json("v")).when(F.col("vec_id") % 4 == 1, as_json).when(F.col("vec_id") % 4 == 2, F.concat(F.lit('{"data": ['), as_json, F.lit("]}"))).otherwise(F.lit("none"))
    return rows.select("vec_id", F.size(vectors.coerce(raw)).alias("size"), F.round(F.coalesce(F.try_element_at(vectors.coerce(raw), F.lit(1)), F.lit(0.0)), 5).alias("first"))


COERCED_SQL = "SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN 0 ELSE len(embedding) END AS size, round(CASE WHEN vec_id % 4 = 3 THEN 0 ELSE embedding[1]::DOUBLE END, 5) AS first FROM embeddings"


def graph_without_parents(spark, d):
    """The edges left when every third entity is deleted."""
    entities, edges = _graph(spark, d)
    _, left = graph.delete(entities, edges, entities.where(F.length("id") % 3 == 0))
    return left


def graph_blocks(spark, d):
    """A block of sentences for the entities of each file, with the kinds of their edges."""
    entities, edges = _graph(spark, d)
    found = graph.render(entities.withColumn("file", F.regexp_replace("id", "_p[0-9]+(_c[0-9]+)?$", "")), edges, "file")
    return found.select("file", F.md5(F.col("block").cast("binary")).alias("digest"))


BLOCKS_SQL = f"""WITH {GRAPH}, k AS (SELECT id, string_agg(DISTINCT type, ', ' ORDER BY type) AS k FROM (SELECT src AS id, type FROM ed UNION ALL SELECT dst, type FROM ed) GROUP BY id)
  SELECT regexp_replace(ent.id, '_p[0-9]+(_c[0-9]+)?$', '') AS file, md5(string_agg(name || ' is a ' || type || coalesce(' (connected via: ' || k || ')', ''), '. ' ORDER BY ent.id) || '.') AS digest FROM ent LEFT JOIN k USING (id) GROUP BY 1"""


def entity_lookup(spark, d):
    """Entities by the ids that chunks name as parents."""
    entities, _ = _graph(spark, d)
    keys = chunks_of(spark, d).where("parent_id is not null").select(F.col("parent_id").alias("id"))
    return tables.lookup(entities, keys, "id").select("id", "name", "type")


def semantic_ingest(spark, d):
    """Documents as semantic chunks, as they would be stored."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("raw"), "text")
    return ingest.ingest(files, "semantic", letter_counts, "letters").select("path", F.md5(F.col("text").cast("binary")).alias("digest"), "text_length", F.col("level").isNull().alias("flat")).distinct()


QUERIES = {
    f.__name__: (f, sql)
    for f, sql in [
        (question_variants, _variants_sql()), (reranked_results, RERANKED_SQL), (pointwise_scores, POINTWISE_SQL), (name_ordered_results, NAME_ORDER_SQL), (entity_results, ENTITY_SQL), (links_for_questions, _links_sql(4, True)), (links_for_context, _links_sql(0, False)),
        (reindexed_links, REINDEXED_SQL), (compressed_contexts, COMPRESSED_SQL), (similar_sentences, _similar_sql()), (model_keywords, MODEL_KEYWORDS_SQL), (image_list, f"SELECT id, label, url FROM {LINKS} WHERE lower(link_type) = 'file' ORDER BY id LIMIT 1000"), (fallback_events, FALLBACK_SQL), (settled_answers, SETTLED_SQL),
        (cleared_turns, CLEARED_SQL), (created_feedback, CREATED_SQL), (session_number, f"SELECT count(DISTINCT session_id) AS sessions FROM {TURNS}"), (chunks_without_files, f"SELECT id, file_id FROM {CHUNKS} WHERE file_id NOT IN (SELECT file_id FROM split_options WHERE file_id IS NOT NULL)"), (grounded_answers, GROUNDED_SQL),
        (repository_chunks, REPOSITORY_SQL), (approximate_recall, RECALL_SQL), (embedding_scores, EMBEDDING_SQL), (cached_answers, CACHED_SQL), (stream_deltas, DELTAS_SQL), (relevance_scores, RELEVANCE_SQL), (coerced_vectors, COERCED_SQL),
        (graph_without_parents, f"WITH {GRAPH} SELECT src, dst, type FROM ed WHERE length(src) % 3 <> 0 AND length(dst) % 3 <> 0"), (graph_blocks, BLOCKS_SQL), (entity_lookup, f"WITH {GRAPH} SELECT id, name, type FROM ent WHERE id IN (SELECT parent_id FROM {CHUNKS})"),
        (semantic_ingest, f"SELECT DISTINCT doc_id::VARCHAR AS path, md5(chunk) AS digest, length(chunk) AS text_length, true AS flat FROM ({chunk_sql.semantic_chunks(LETTERS)}) WHERE {HAS_LETTERS}"),
    ]
}
