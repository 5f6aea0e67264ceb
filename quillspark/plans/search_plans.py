"""Queries on retrieval, links, graphs and answers, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import scoring, vectors
from quillspark.functions import text as T
from quillspark.operators import answers as A
from quillspark.operators import graph, links, retrieval
from quillspark.functions.fixed import DOMAIN_STOP, FREQUENCY_STOP, GRAPH_LATIN, TO_LATIN
from quillspark.plans import ask, chunk_sql, ingest
from quillspark.plans.table_plans import CHUNKS, LINKS, TURNS, chunks_of, links_of, turns_of
from quillspark.session import table

USABLE = "len({0}) = 96 AND len(list_filter({0}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def asked_of(spark, d):
    """Each stored vector query with a keyword of the reference terms."""
    terms = table(spark, d, "canon_terms").where("kind = 'keyword'").select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("term_id")).alias("n"), "term")
    rows = table(spark, d, "vector_queries").select("query_id", "vector", (F.pmod("query_id", F.lit(51)) + 1).cast("int").alias("n"))
    return rows.join(terms, "n", "left").select("query_id", "vector", F.array_compact(F.array("term")).alias("keywords"))


ASKED = "(SELECT query_id, vector, CASE WHEN term IS NULL THEN [] ELSE [term] END AS keywords FROM vector_queries q LEFT JOIN (SELECT row_number() OVER (ORDER BY term_id) AS n, term FROM canon_terms WHERE kind = 'keyword') t ON t.n = q.query_id % 51 + 1)"


def nearest_chunks(spark, d):
    base = chunks_of(spark, d).where(~F.col("level").eqNullSafe(F.lit(0)))
    found = retrieval.nearest(base, "id", "embedding", table(spark, d, "vector_queries"), "query_id", "vector", 10, 96)
    return found.select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def _cosine_sql(a: str, b: str) -> str:
    return f"CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0 ELSE list_cosine_similarity({a}, {b}) END"


NEAREST_SQL = f"""WITH q AS (SELECT query_id, vector::DOUBLE[] AS v FROM vector_queries WHERE {USABLE.format('vector')}), b AS (SELECT id, embedding::DOUBLE[] AS e FROM {CHUNKS} WHERE level IS DISTINCT FROM 0 AND {USABLE.format('embedding')}),
  s AS (SELECT query_id, id, {_cosine_sql('v', 'e')} AS score FROM q, b)
  SELECT query_id, id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10"""


def near_turns_by_threshold(spark, d):
    """At most 100 turns of at least the balanced mode's similarity."""
    found = retrieval.nearest(turns_of(spark, d), "id", "embedding", table(spark, d, "vector_queries"), "query_id", "vector", 100, 96, threshold=scoring.THRESHOLDS["balanced"])
    return found.select("query_id", "id", F.round("score", 5).alias("score"))


def vector_metrics(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return pairs.select("vec_id", *(F.round(m, 4).alias(n) for n, m in (("cosine", vectors.cosine(a, b)), ("dot", vectors.dot(a, b)), ("euclid", vectors.euclid(a, b)), ("manhattan", vectors.manhattan(a, b)))))


METRICS_SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 4) AS cosine, round(list_dot_product(a.v, b.v), 4) AS dot, round(list_distance(a.v, b.v), 4) AS euclid,
  round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2]))), 4) AS manhattan FROM e a JOIN e b ON b.vec_id = a.vec_id + 1"""


#: The reference looks at the first 500 keyword matches of a query by id, and so does the SQL of keyword_chunks and hybrid_chunks.
PARITY_LIMIT = 500


def keyword_chunks(spark, d):
    base = chunks_of(spark, d).where(~F.col("level").eqNullSafe(F.lit(0)) & (F.col("text_length") >= 80))
    return retrieval.keyword_matches(base, asked_of(spark, d), PARITY_LIMIT)


_URL = "https?://\\S+|\\b[\\w-]+\\.[\\w.-]+\\.\\w{2,}\\b"


def _listed_sql(asked: str, cap: int | None, least: int, n: str = "") -> str:
    """Common table expressions a (queries), c (chunks), w (words of queries), m (keyword matches), each with the suffix n."""
    limit = f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= {cap}" if cap else ""
    return f"""a{n} AS {asked}, c{n} AS (SELECT id, text, parent_text, coalesce(context_keywords, []) AS kw, embedding, text_length FROM {CHUNKS} WHERE level IS DISTINCT FROM 0),
  w{n} AS (SELECT DISTINCT query_id, unnest(list_concat(list_transform(keywords, lambda k: lower(k)), list_filter(flatten(list_transform(keywords, lambda k: regexp_split_to_array(lower(k), '\\s+'))), lambda p: length(p) > 2))) AS word FROM a{n}),
  i{n} AS (SELECT DISTINCT id, unnest(list_concat(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), list_transform(kw, lambda k: lower(k)))) AS word FROM c{n} WHERE text_length >= {least}),
  m{n} AS (SELECT query_id, id FROM (SELECT DISTINCT query_id, id FROM w{n} JOIN i{n} USING (word)) {limit})"""


KEYWORD_SQL = f"WITH {_listed_sql(ASKED, PARITY_LIMIT, 80)} SELECT query_id, id FROM m"


def hybrid_sql(mode: str = "balanced", limit: int = 10, cap: int | None = None, least: int = 80, asked: str = ASKED, phrases: dict | None = None, n: str = "") -> str:
    """Common table expressions that end in s<n>: query_id, id, vs, ks, hs, text, parent_text of all candidates, and t<n>: the best of them."""
    wv, wk, wanted, more = scoring.MODES[mode]
    keyword = f"UNION ALL SELECT query_id, id, 0.01 FROM m{n} ANTI JOIN n{n} USING (query_id, id)" if mode != "precise" else ""
    extra = "".join(f", CASE WHEN list_contains(list_transform(keywords, lambda q: lower(q)), '{k}') THEN ['{"', '".join(v)}'] ELSE [] END" for k, v in (phrases or {}).items())
    return f"""{_listed_sql(asked, cap, least, n)}, n{n} AS (SELECT query_id, id, {_cosine_sql('v', 'e')} AS vs FROM (SELECT query_id, vector::DOUBLE[] AS v FROM a{n} WHERE {USABLE.format('vector')}), (SELECT id, embedding::DOUBLE[] AS e FROM c{n} WHERE {USABLE.format('embedding')})
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(vs, 9) DESC, id) <= {limit * more}),
  u{n} AS (SELECT query_id, id, vs FROM n{n} {keyword}),
  t1{n} AS (SELECT u{n}.*, c{n}.text, c{n}.parent_text, lower(c{n}.text) AS low, c{n}.kw, len(regexp_split_to_array(c{n}.text, '\\s+')) AS dl, a{n}.keywords,
    (length(trim(c{n}.text, ' ')) >= {least} OR regexp_matches(c{n}.text, '{_URL}')) AND NOT regexp_matches(trim(c{n}.text, ' '), '^\\[[^\\]]{{2,60}}\\][\\s\\\\]*$') AS keep FROM u{n} JOIN c{n} USING (id) JOIN a{n} USING (query_id)),
  k{n} AS (SELECT *, bool_or(coalesce(keep, false)) OVER (PARTITION BY query_id) AS kept_any FROM t1{n}),
  x{n} AS (SELECT * EXCLUDE (keep, kept_any), list_distinct(flatten([list_transform(keywords, lambda q: lower(q)), list_filter(flatten(list_transform(keywords, lambda q: regexp_split_to_array(lower(q), '\\s+'))), lambda p: length(p) > 2){extra}])) AS words, avg(dl) OVER (PARTITION BY query_id) AS mean FROM k{n} WHERE coalesce(keep, false) OR NOT kept_any),
  y{n} AS (SELECT *, list_filter(words, lambda q: contains(low, q) OR len(list_filter(kw, lambda z: contains(lower(z), q))) > 0) AS hit FROM x{n}),
  z{n} AS (SELECT *, CASE WHEN len(hit) >= {wanted} THEN coalesce(list_sum(list_transform(hit, lambda q: ((length(low) - length(replace(low, q, ''))) / length(q)) * 2.5 / ((length(low) - length(replace(low, q, ''))) / length(q) + 1.5 * (0.25 + 0.75 * dl / mean)))), 0) + 0.5 * len(hit)
    + CASE WHEN len(list_filter(hit, lambda q: len(list_filter(regexp_extract_all(low, '{_URL}'), lambda l: contains(l, q))) > 0)) > 0 THEN 2 ELSE 0 END ELSE 0 END AS ks FROM y{n}),
  s{n} AS (SELECT *, {wv} * CASE WHEN max(vs) OVER g = min(vs) OVER g THEN 1 ELSE (vs - min(vs) OVER g) / (max(vs) OVER g - min(vs) OVER g) END + {wk} * CASE WHEN max(ks) OVER g = min(ks) OVER g THEN 1 ELSE (ks - min(ks) OVER g) / (max(ks) OVER g - min(ks) OVER g) END AS hs FROM z{n} WINDOW g AS (PARTITION BY query_id)),
  t{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hs, 9) DESC, id) AS rank FROM s{n} QUALIFY rank <= {limit})"""


_SHOWN = "SELECT query_id, id, round(vs, 5) AS vector_score, round(ks, 5) AS keyword_score, round(hs, 5) AS hybrid_score, rank, length(concat_ws(' ', text, parent_text)) AS length FROM t"


def _hybrid_in(mode: str, cap: int | None = None, phrases: dict | None = None):
    def run(spark, d):
        found = retrieval.hybrid_search(table(spark, d, "chunks"), asked_of(spark, d), 10, mode, keyword_limit=cap, phrases=phrases, shown={"length": F.length(F.concat_ws(" ", "text", "parent_text"))})
        return found.select("query_id", "id", *(F.round(c, 5).alias(c) for c in ("vector_score", "keyword_score", "hybrid_score")), "rank", "length")

    return run, f"WITH {hybrid_sql(mode, cap=cap, phrases=phrases)} {_SHOWN}"


hybrid_chunks, HYBRID_SQL = _hybrid_in("balanced", PARITY_LIMIT)
#: A caller's phrases and what they stand for.
PHRASES = {"onboarding": ["onboard", "newcomer"], "відпустка": ["vacation", "leave"], "vpn": ["tunnel"]}


def _ranked_lists(spark, d):
    rows = table(spark, d, "search_results")
    return rows.select("query_id", "result_id", F.explode(F.array(*(F.struct(F.lit(c).alias("list"), F.col(c).alias("score")) for c in ("vector_score", "keyword_score", "hybrid_score")))).alias("l")).select("query_id", "result_id", "l.list", "l.score").where("score is not null")


def fused_results(spark, d):
    return retrieval.reciprocal_rank_fusion(_ranked_lists(spark, d), "query_id", "list", "result_id", "score").select("query_id", "result_id", F.round("fused", 8).alias("fused"))


_LISTS = "(SELECT query_id, result_id, unnest(['vector_score', 'keyword_score', 'hybrid_score']) AS list, unnest([vector_score, keyword_score, hybrid_score]) AS score FROM search_results)"
FUSED_SQL = f"WITH p AS (SELECT query_id, result_id, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, result_id) AS n FROM {_LISTS} WHERE score IS NOT NULL) SELECT query_id, result_id, round(sum(1.0 / (60 + n)), 8) AS fused FROM p GROUP BY ALL"


def merged_results(spark, d):
    rows = table(spark, d, "search_results")
    main = rows.where("vector_score is not null").select("query_id", "result_id", F.col("vector_score").alias("score"))
    other = rows.where("keyword_score is not null").select("query_id", "result_id", F.col("keyword_score").alias("score"))
    return retrieval.merge_secondary(main, other, "query_id", "result_id", "score").select("query_id", "result_id", F.round("score", 8).alias("score"))


MERGED_SQL = "SELECT query_id, result_id, round(sum(s), 8) AS score FROM (SELECT query_id, result_id, vector_score AS s FROM search_results WHERE vector_score IS NOT NULL UNION ALL SELECT query_id, result_id, keyword_score * 0.9 / 61 FROM search_results WHERE keyword_score IS NOT NULL) GROUP BY ALL"


def parent_contexts(spark, d):
    parents = table(spark, d, "chunks").where("level = 0 and chunk_id is not null").groupBy("chunk_id").agg(F.max("text").alias("text"))
    results = table(spark, d, "search_results").where("text is not null").select("query_id", F.col("result_id").alias("id"), "text", "parent_id", F.lit(None).cast("string").alias("parent_text"), "pos")
    found = retrieval.expand_parents(results, parents, "query_id", "pos")
    return found.select("query_id", "id", "parent_id", "first", F.md5(F.col("text").cast("binary")).alias("digest"))


PARENTS_SQL = """WITH r AS (SELECT * FROM search_results WHERE text IS NOT NULL), p AS (SELECT chunk_id, max(text) AS t FROM chunks WHERE level = 0 AND chunk_id IS NOT NULL GROUP BY chunk_id),
  o AS (SELECT query_id, parent_id, text, min((pos, text)) AS k FROM r WHERE parent_id IS NOT NULL GROUP BY ALL),
  g AS (SELECT query_id, parent_id, string_agg(text, chr(10) || chr(10) ORDER BY k) AS c FROM o GROUP BY ALL),
  f AS (SELECT query_id, parent_id, arg_min(result_id, pos) AS id, min(pos) AS first FROM r WHERE parent_id IS NOT NULL GROUP BY ALL)
  SELECT query_id, id, parent_id, first, md5(left(CASE WHEN coalesce(t, '') <> '' THEN t || chr(10) || chr(10) || c ELSE c END, 6000)) AS digest FROM f JOIN g USING (query_id, parent_id) LEFT JOIN p ON p.chunk_id = parent_id
  UNION ALL SELECT query_id, result_id, NULL, pos, md5(text) FROM r WHERE parent_id IS NULL"""


def links_by_keywords(spark, d):
    asked = asked_of(spark, d).select("query_id", "keywords")
    return links.find_by_keywords(links_of(spark, d), asked).select("query_id", "url", "id", "relevance", "rank")


LINK_SEARCH_SQL = f"""WITH a AS (SELECT DISTINCT query_id, lower(unnest(keywords)) AS w FROM {ASKED}), l AS {LINKS},
  h AS (SELECT query_id, id, url, created_at, max(CASE WHEN list_contains(keywords, w) THEN 2 ELSE 0 END) + max(CASE WHEN contains(lower(label), w) THEN 1 ELSE 0 END) + max(CASE WHEN contains(lower(context), w) THEN 1 ELSE 0 END) + max(CASE WHEN contains(lower(source_file), w) THEN 1 ELSE 0 END) AS relevance FROM a, l GROUP BY ALL),
  o AS (SELECT * FROM h WHERE relevance > 0 QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY relevance DESC, created_at DESC, id) = 1),
  u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY url) <= 30)
  SELECT query_id, url, id, relevance::INT AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, url) AS rank FROM u"""


def link_scores(spark, d):
    """Score of every link for a question made of its own label."""
    rows = links_of(spark, d).where("label is not null")
    q = F.concat(F.lit("Where is the file of "), F.col("label"))
    score = links.score(q, T.query_keywords(q), F.col("label"), F.col("context"), F.col("source_file"), F.col("keywords"), F.col("link_type"))
    return rows.select("id", score.alias("score"))


LINK_SCORE_SQL = f"""WITH q AS (SELECT *, lower('Where is the file of ' || label) AS q, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower('Where is the file of ' || label), '[?!.,;:''"]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({', '.join("'" + w + "'" for w in T.QUERY_STOP)})))[1:15] AS ks FROM {LINKS} WHERE label IS NOT NULL)
  SELECT id, (10 + coalesce(list_sum(list_transform(ks, lambda k: CASE WHEN len(list_filter(coalesce(keywords, []), lambda o: starts_with(o, k))) > 0 THEN 3 ELSE 0 END + CASE WHEN contains(lower(label), k) THEN 2 ELSE 0 END + CASE WHEN contains(lower(coalesce(context, '')), k) THEN 1 ELSE 0 END + CASE WHEN contains(lower(coalesce(source_file, '')), k) THEN 1 ELSE 0 END)), 0)
  + CASE WHEN link_type = 'image' AND regexp_matches(q, 'фото|image|photo|зображ|скрин') OR link_type = 'video' AND regexp_matches(q, 'відео|video|запис') THEN 5 ELSE 0 END)::INT AS score FROM q"""


def image_results(spark, d):
    """Results treated as images: chunk keywords against wanted and excluded words."""
    rows = table(spark, d, "search_results").where("vector_score is not null").join(chunks_of(spark, d).select(F.col("id").alias("chunk_ref"), "context_keywords"), "chunk_ref")
    images = rows.select("query_id", F.col("result_id").alias("id"), F.col("context_keywords").alias("keywords"), F.col("vector_score").alias("score"))
    asked = table(spark, d, "vector_queries").select("query_id", F.array(F.lit("report"), F.lit("leave")).alias("include"), F.when(F.col("query_id") % 2 == 0, F.array(F.lit("index"))).otherwise(F.array().cast("array<string>")).alias("exclude"))
    return retrieval.image_search(images, asked, 10, 0.3).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


IMAGE_RESULTS_SQL = f"""WITH i AS (SELECT query_id, result_id AS id, vector_score AS s, list_transform(coalesce(context_keywords, []), lambda k: lower(k)) AS k FROM search_results JOIN {CHUNKS} c ON c.id = chunk_ref WHERE vector_score IS NOT NULL AND query_id IN (SELECT query_id FROM vector_queries)),
  b AS (SELECT query_id, id, k, CASE WHEN query_id % 2 <> 0 THEN s WHEN list_contains(k, 'index') THEN greatest(0, s - 0.2) ELSE least(1, s + 0.2) END AS s FROM i),
  f AS (SELECT query_id, id, s + 0.2 * len(list_filter(['report', 'leave'], lambda w: len(list_filter(k, lambda x: contains(x, w) OR levenshtein(x, w) <= 1)) > 0)) AS s FROM b)
  SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM f WHERE s >= 0.3 QUALIFY rank <= 10"""


def image_matches(spark, d):
    """Described images (here the turns, with the words of the question as keywords): the nearest 100 of at least the balanced similarity, then wanted and excluded words."""
    base = turns_of(spark, d).select("id", "embedding", F.split(F.lower(F.coalesce("query", F.lit(""))), " ").alias("keywords"))
    near = retrieval.nearest(base, "id", "embedding", table(spark, d, "vector_queries"), "query_id", "vector", 100, 96, threshold=scoring.THRESHOLDS["balanced"])
    images = near.join(base.select("id", "keywords"), "id").select("query_id", "id", "keywords", "score")
    asked = table(spark, d, "vector_queries").select("query_id", F.array(F.lit("report"), F.lit("leave")).alias("include"), F.array(F.lit("index")).alias("exclude"))
    return retrieval.image_search(images, asked, 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


IMAGE_MATCHES_SQL = f"""WITH q AS (SELECT query_id, vector::DOUBLE[] AS v FROM vector_queries WHERE {USABLE.format('vector')}), b AS (SELECT id, string_split(lower(coalesce(query, '')), ' ') AS k, embedding::DOUBLE[] AS e FROM {TURNS} WHERE {USABLE.format('embedding')}),
  n AS (SELECT query_id, id, k, {_cosine_sql('v', 'e')} AS s FROM q, b QUALIFY s >= 0.65 AND row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) <= 100),
  f AS (SELECT query_id, id, CASE WHEN list_contains(k, 'index') THEN greatest(0, s - 0.2) ELSE least(1, s + 0.2) END + 0.2 * len(list_filter(['report', 'leave'], lambda w: len(list_filter(k, lambda x: contains(x, w) OR levenshtein(x, w) <= 1)) > 0)) AS s FROM n)
  SELECT query_id, id, round(s, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM f WHERE s >= 0 QUALIFY rank <= 10"""


def _graph(spark, d):
    rows = chunks_of(spark, d).where("chunk_id is not null")
    entities = rows.select(F.col("chunk_id").alias("id"), F.coalesce("section_title", "chunk_id").alias("name"), F.when(F.col("level") == 0, "parent").otherwise("child").alias("type"))
    kids = rows.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("PART_OF").alias("type"))
    listed = rows.select(F.col("chunk_id").alias("src"), F.explode("child_ids").alias("dst"), F.lit("LISTS").alias("type"))
    return graph.merge(entities, kids.unionByName(listed))


GRAPH = f"""r AS (SELECT * FROM {CHUNKS} WHERE chunk_id IS NOT NULL), en AS (SELECT chunk_id AS id, min((coalesce(section_title, chunk_id), CASE WHEN level = 0 THEN 'parent' ELSE 'child' END)) AS s FROM r GROUP BY 1),
  ent AS (SELECT id, s[1] AS name, s[2] AS type FROM (SELECT id, [s[1], s[2]] AS s FROM en)),
  ed AS (SELECT DISTINCT src, dst, type FROM (SELECT parent_id AS src, chunk_id AS dst, 'PART_OF' AS type FROM r WHERE parent_id IS NOT NULL UNION ALL SELECT chunk_id, unnest(child_ids), 'LISTS' FROM r) WHERE src IN (SELECT id FROM ent) AND dst IN (SELECT id FROM ent))"""


def graph_edges(spark, d):
    return _graph(spark, d)[1].select("src", "dst", "type")


def graph_stats(spark, d):
    found = graph.stats(*_graph(spark, d))
    return found.select("entities", "edges", F.coalesce(F.col("by_type")["parent"], F.lit(0)).alias("parents"), F.coalesce(F.col("by_type")["child"], F.lit(0)).alias("children"))


def graph_neighbourhood(spark, d):
    entities, edges = _graph(spark, d)
    return graph.neighbourhood(edges, entities.where("type = 'child'").select("id"), 2)


NEIGHBOURHOOD_SQL = f"""WITH {GRAPH}, b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM ed UNION ALL SELECT dst, src FROM ed) WHERE src <> dst), s AS (SELECT id AS seed FROM ent WHERE type = 'child'),
  o AS (SELECT DISTINCT seed, dst AS id FROM s JOIN b ON b.src = seed), t AS (SELECT DISTINCT seed, b.dst AS id FROM o JOIN b ON b.src = o.id WHERE b.dst <> seed),
  a AS (SELECT seed, id, 1 AS distance FROM o UNION ALL SELECT seed, id, 2 FROM t ANTI JOIN o USING (seed, id))
  SELECT seed, id, distance FROM a QUALIFY row_number() OVER (PARTITION BY seed ORDER BY distance, id) <= 50"""


def graph_matches(spark, d):
    """Entities whose name holds a word of a reference term."""
    entities, _ = _graph(spark, d)
    words = table(spark, d, "canon_terms").select("term_id", F.explode(F.array_distinct(F.split(F.lower("term"), r"[^\p{L}\p{N}]+"))).alias("query")).where(F.length("query") > 3)
    return graph.find(entities, words.select(F.concat_ws(":", "term_id", "query").alias("query_id"), "query")).select("query_id", "id", "type")


MATCHES_SQL = f"""WITH {GRAPH}, q AS (SELECT DISTINCT term_id || ':' || w AS query_id, w AS q FROM (SELECT term_id, unnest(regexp_split_to_array(lower(term), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM canon_terms) WHERE length(w) > 3)
  SELECT query_id, id, type FROM q JOIN ent ON contains(lower(name), q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 25"""


def _extracted(spark, d):
    """Entities and edges from JSON answers, made of links as a model would give them."""
    made = F.to_json(F.struct(
        F.array(F.struct(F.col("label").alias("name"), F.lit("Product").alias("type")), F.struct(F.concat(F.lit("Team "), "link_type").alias("name"), F.lit("Concept").alias("type")), F.struct(F.lit("12 days").alias("name"), F.lit("concept").alias("type"))).alias("entities"),
        F.array(F.struct(F.col("label").alias("from"), F.lit("part_of").alias("relation"), F.concat(F.lit("team "), "link_type").alias("to")), F.struct(F.col("label").alias("from"), F.lit("uses").alias("relation"), F.col("label").alias("to"))).alias("relations"),
    ))
    rows = links_of(spark, d).where("label is not null and link_type is not null").select(F.col("id").alias("link_id"), F.concat(F.lit("Here it is: "), made).alias("json"))
    return graph.extract(rows, "link_id", "json")


def extracted_entities(spark, d):
    return _extracted(spark, d)[0].select("link_id", "id", "type")


def extracted_edges(spark, d):
    return _extracted(spark, d)[1].select("link_id", "src", "dst", "type")


def _extracted_sql() -> str:
    noisy = "length(t) < 2 OR length(t) > 60 OR regexp_matches(t, '[!?]') OR (NOT regexp_matches(t, '\\s') AND regexp_matches(t, '[._]')) OR regexp_matches(t, '^\\d+(\\s+\\S{1,6})?$') OR (type = 'concept' AND regexp_matches(t, '\\d'))"
    latin = "lower(name)"
    for a, b in (TO_LATIN | GRAPH_LATIN).items():
        latin = f"replace({latin}, '{a}', '{b}')"
    return f"""WITH l AS (SELECT id AS link_id, label, link_type FROM {LINKS} WHERE label IS NOT NULL AND link_type IS NOT NULL),
  n AS (SELECT link_id, label AS name, 'product' AS type FROM l UNION ALL SELECT link_id, 'Team ' || link_type, 'concept' FROM l UNION ALL SELECT link_id, '12 days', 'concept' FROM l),
  e AS (SELECT link_id, name, type, regexp_replace(regexp_replace({latin}, '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') || '_' || type AS id FROM (SELECT *, trim(name, ' ') AS t FROM n WHERE name <> '') WHERE NOT ({noisy}))"""


EXTRACTED_ENTITIES_SQL = f"{_extracted_sql()} SELECT link_id, id, type FROM e"
EXTRACTED_EDGES_SQL = f"""{_extracted_sql()}, i AS (SELECT link_id, lower(name) AS n, max(id) AS i FROM e GROUP BY ALL), r AS (SELECT link_id, lower(label) AS f, lower('team ' || link_type) AS t, 'PART_OF' AS type FROM l UNION ALL SELECT link_id, lower(label), lower(label), 'USES' FROM l)
  SELECT DISTINCT r.link_id, a.i AS src, b.i AS dst, type FROM r JOIN i a ON a.link_id = r.link_id AND a.n = f JOIN i b ON b.link_id = r.link_id AND b.n = t WHERE a.i <> b.i"""


def rerank_scores(spark, d):
    """Results reranked by similarity of query vector and chunk vector."""
    rows = table(spark, d, "search_results").join(table(spark, d, "vector_queries").select("query_id", "vector"), "query_id").join(chunks_of(spark, d).select(F.col("id").alias("chunk_ref"), "embedding"), "chunk_ref")
    rows = rows.where(vectors.valid(F.col("vector"), 96) & vectors.valid(F.col("embedding"), 96))
    scored = rows.withColumn("final", A.hybrid_rerank(F.col("hybrid_score"), vectors.cosine(F.col("vector"), F.col("embedding"))))
    return A.top(scored, "query_id", "final", "result_id", 5).select("query_id", "result_id", F.round("final", 5).alias("final"), "rank")


RERANK_SQL = f"""WITH s AS (SELECT query_id, result_id, 0.3 * coalesce(hybrid_score, 0) + 0.7 * {_cosine_sql('v', 'e')} AS f FROM search_results JOIN (SELECT query_id, vector::DOUBLE[] AS v FROM vector_queries WHERE {USABLE.format('vector')}) USING (query_id)
    JOIN (SELECT id, embedding::DOUBLE[] AS e FROM {CHUNKS} WHERE {USABLE.format('embedding')}) ON id = chunk_ref)
  SELECT query_id, result_id, round(f, 5) AS final, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, result_id) AS rank FROM s QUALIFY rank <= 5"""


def listwise_scores(spark, d):
    """A model's ranking of each result list: here the places backwards, without the last one."""
    rows = table(spark, d, "search_results").select("query_id", "result_id", F.col("hybrid_score").alias("score"), F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "result_id")).alias("pos"))
    said = rows.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.when(F.col("query_id") % 7 == 0, F.lit("none")).otherwise(F.concat(F.lit("Ranking: ["), F.array_join(F.slice(F.sequence(F.col("n"), F.lit(1)), 1, F.greatest(F.lit(1), F.col("n") - 1)), ", "), F.lit("]"))).alias("answer"))
    return A.listwise(rows, said, "query_id").select("query_id", "result_id", F.round("rerank_score", 6).alias("rerank_score"))


LISTWISE_SQL = """WITH r AS (SELECT query_id, result_id, hybrid_score, row_number() OVER (PARTITION BY query_id ORDER BY pos, result_id) AS p, count(*) OVER (PARTITION BY query_id) AS n FROM search_results)
  SELECT query_id, result_id, round(CASE WHEN query_id % 7 = 0 THEN coalesce(hybrid_score, 0) WHEN p = 1 AND n > 1 THEN 0 ELSE 1 - (n - p) / n END, 6) AS rerank_score FROM r"""


def compressed_answers(spark, d):
    rows = turns_of(spark, d).where("query is not null and answer is not null")
    found = A.compress(rows, ["id"], "query", "answer", budget=20)
    return found.select("id", F.size("relevant").alias("sentences"), F.length("compressed").alias("length"), F.round("ratio", 6).alias("ratio"))


COMPRESS_SQL = f"""WITH t AS (SELECT id, answer, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(query), '\\s+'), lambda w: regexp_replace(w, '[^a-zа-яіїєґ]', '', 'g')), lambda w: length(w) > 2)) AS q, CASE WHEN len(regexp_extract_all(answer, '[^.!?]+[.!?]+')) > 0 THEN regexp_extract_all(answer, '[^.!?]+[.!?]+') ELSE [answer] END AS l FROM {TURNS} WHERE query IS NOT NULL AND answer IS NOT NULL),
  s AS (SELECT id, answer, q, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM t),
  m AS (SELECT id, answer, s, i, len(list_filter(regexp_split_to_array(lower(s), '\\s+'), lambda w: list_contains(q, regexp_replace(w, '[^a-zа-яіїєґ]', '', 'g')))) AS m, len(regexp_split_to_array(s, '\\s+')) AS n FROM s),
  o AS (SELECT *, row_number() OVER w AS r, sum(n) OVER w AS upto FROM m WINDOW w AS (PARTITION BY id ORDER BY m DESC, i ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT id, answer, string_agg(s, ' ' ORDER BY r) FILTER (r <= 15 AND upto <= 20) AS c, count(*) FILTER (r <= 15 AND upto <= 20) AS n FROM o GROUP BY id, answer)
  SELECT id, n AS sentences, length(coalesce(c, '')) AS length, round(CASE WHEN length(answer) > 0 THEN length(coalesce(c, '')) / length(answer) ELSE 0 END, 6) AS ratio FROM k"""


def _top_answers(spark, d):
    rows = table(spark, d, "search_results").where("text is not null")
    return rows, rows.groupBy("query_id").agg(F.min_by("text", F.struct("pos", "result_id")).alias("answer"))


def result_citations(spark, d):
    """The first result of a query as its answer, and what it shares with the others."""
    rows, said = _top_answers(spark, d)
    docs = rows.select("query_id", F.col("pos").alias("doc_pos"), F.col("result_id").alias("id"), "text")
    return A.citations(said, docs, "query_id").select("query_id", "number", "id", "n", F.md5(F.col("sentence").cast("binary")).alias("digest"))


CITATIONS_SQL = r"""WITH r AS (SELECT * FROM search_results WHERE text IS NOT NULL), a AS (SELECT query_id, arg_min(text, (pos, result_id)) AS answer FROM r GROUP BY query_id),
  e AS (SELECT query_id, pos, result_id, regexp_extract_all(text, '[^.!?…]+[.!?…]+') AS l FROM r), s AS (SELECT query_id, pos, result_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS n FROM e),
  w AS (SELECT s.*, lower(answer) AS low, list_filter(regexp_split_to_array(lower(s), '\s+'), lambda x: length(x) > 2) AS ws FROM s JOIN a USING (query_id) WHERE length(s) >= 20),
  u AS (SELECT * FROM w WHERE len(ws) > 0 AND len(list_filter(ws, lambda x: contains(low, x))) > 0.6 * len(ws))
  SELECT query_id, dense_rank() OVER (PARTITION BY query_id ORDER BY pos) AS number, result_id AS id, n, md5(s) AS digest FROM u"""


def answer_confidence(spark, d):
    """How near the nearest of a query's results is that shares a word with its first one, and what follows."""
    rows, said = _top_answers(spark, d)
    asked = said.join(table(spark, d, "vector_queries").select("query_id", "vector"), "query_id").where(vectors.valid(F.col("vector"), 96))
    chunks = rows.join(chunks_of(spark, d).select(F.col("id").alias("chunk_ref"), "embedding"), "chunk_ref").where(vectors.valid(F.col("embedding"), 96)).select("query_id", "pos", "text", "embedding")
    found = A.confidence(asked, chunks, "query_id", vectors.cosine(F.col("vector"), F.col("embedding")))
    grounded, verdict = A.verify(F.col("score"), F.col("tier"), F.lit(0.5))
    kept = found.withColumns({"grounded": grounded, "verdict": verdict})
    text, ok = A.final_answer(F.lit("kept"), F.col("grounded"), F.col("tier"), F.col("verdict"))
    return kept.select("query_id", F.round("score", 5).alias("score"), "tier", "grounded", "verdict", text.alias("answer"), ok.alias("accepted"))


CONFIDENCE_SQL = rf"""WITH r AS (SELECT * FROM search_results WHERE text IS NOT NULL), a AS (SELECT query_id, arg_min(text, (pos, result_id)) AS answer FROM r GROUP BY query_id),
  q AS (SELECT query_id, answer, vector::DOUBLE[] AS v, regexp_extract_all(lower(answer), '[A-Za-z0-9_]+') AS ws FROM a JOIN vector_queries USING (query_id) WHERE {USABLE.format('vector')}),
  c AS (SELECT query_id, {_cosine_sql('v', 'e')} AS s, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM r JOIN q USING (query_id) JOIN (SELECT id, embedding::DOUBLE[] AS e FROM {CHUNKS} WHERE {USABLE.format('embedding')}) ON id = chunk_ref
    WHERE trim(answer, ' ') <> '' AND len(list_filter(ws, lambda w: contains(lower(text), w))) > 0),
  b AS (SELECT query_id, max(s) AS s FROM c WHERE n <= 5 GROUP BY query_id), f AS (SELECT query_id, coalesce(s, 0) AS s, CASE WHEN coalesce(s, 0) >= 0.85 THEN 'HIGH' WHEN coalesce(s, 0) < 0.65 THEN 'LOW' ELSE 'GRAY_ZONE' END AS tier FROM q LEFT JOIN b USING (query_id)),
  g AS (SELECT *, CASE tier WHEN 'HIGH' THEN true WHEN 'LOW' THEN false ELSE (s + 0.5) / 2 >= 0.65 END AS grounded, CASE WHEN tier = 'GRAY_ZONE' THEN 'YES' END AS verdict FROM f)
  SELECT query_id, round(s, 5) AS score, tier, grounded, verdict, CASE WHEN grounded AND tier <> 'LOW' THEN 'kept' ELSE '{A.FALLBACK}' END AS answer, grounded AND tier <> 'LOW' AS accepted FROM g"""

def multi_query_chunks(spark, d):
    """Two variants of each stored query, with its own and with another keyword, fused."""
    asked = asked_of(spark, d)
    extra = F.array_union("keywords", F.array(F.lit("onboarding")))
    variants = asked.select("query_id", F.lit(0).alias("variant"), "vector", "keywords").unionByName(asked.select("query_id", F.lit(1).alias("variant"), "vector", extra.alias("keywords")))
    return ask.retrieve(table(spark, d, "chunks"), variants, 10).select("query_id", "id", F.round("fused", 8).alias("fused"), "rank")


_TWO = f"(SELECT query_id * 10 AS query_id, vector, keywords FROM {ASKED} UNION ALL SELECT query_id * 10 + 1, vector, CASE WHEN list_contains(keywords, 'onboarding') THEN keywords ELSE list_append(keywords, 'onboarding') END FROM {ASKED})"
MULTI_SQL = f"""WITH {hybrid_sql(asked=_TWO, n='p')}, missing AS (SELECT * FROM {_TWO} WHERE query_id // 10 NOT IN (SELECT query_id // 10 FROM tp)), {hybrid_sql('wide', least=0, asked='(SELECT * FROM missing)', n='q')},
  l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY hs DESC, id) AS n FROM (SELECT query_id, id, hs FROM tp UNION ALL SELECT query_id, id, hs FROM tq)), f AS (SELECT query_id // 10 AS query_id, id, sum(1.0 / (60 + n)) AS fused FROM l GROUP BY ALL)
  SELECT query_id, id, round(fused, 8) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, id) AS rank FROM f QUALIFY rank <= 10"""


def adaptive_chunks(spark, d):
    """Every third question asks for a name."""
    asked = asked_of(spark, d).withColumn("entity", F.col("query_id") % 3 == 0)
    found = ask.adaptive(table(spark, d, "chunks"), asked, 10, trust=0.6, entity="entity")
    return found.select("query_id", "id", F.round("score", 5).alias("score"), "hybrid")


ADAPTIVE_SQL = f"""WITH nq AS (SELECT query_id, keywords, vector::DOUBLE[] AS v FROM {ASKED} WHERE {USABLE.format('vector')}), nb AS (SELECT id, text, embedding::DOUBLE[] AS e FROM {CHUNKS} WHERE level IS DISTINCT FROM 0 AND {USABLE.format('embedding')}),
  near AS (SELECT query_id, id, keywords, text, {_cosine_sql('v', 'e')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM nq, nb QUALIFY rank <= 10),
  sure AS (SELECT query_id FROM near WHERE rank <= 3 GROUP BY query_id HAVING avg(score) >= 0.6 AND (query_id % 3 <> 0 OR len(any_value(keywords)) = 0 OR bool_or(len(list_filter(keywords, lambda k: contains(lower(text), lower(k)))) > 0))),
  rest AS (SELECT * FROM {ASKED} WHERE query_id NOT IN (SELECT query_id FROM sure)), {hybrid_sql(asked='(SELECT * FROM rest)')}
  SELECT query_id, id, round(score, 5) AS score, false AS hybrid FROM near WHERE query_id IN (SELECT query_id FROM sure) UNION ALL SELECT query_id, id, round(hs, 5), true FROM t"""


def _files(spark, d):
    return table(spark, d, "documents").select(F.concat("file_id", F.lit("_"), F.col("doc_id"), F.lit(".md")).alias("name"), F.col("text").alias("raw"), F.col("text").alias("text"))


def ingested_documents(spark, d):
    """The documents as parents and children with keywords and vectors, as they would be stored."""
    return ingest.ingest(_files(spark, d), "parent_child").select("id", "file_id", "parent_id", "level", "text_length", F.col("embedding").isNotNull().alias("embedded"))


_FILE_ID = "left(lower(regexp_replace(file_id || '_' || doc_id, '[^a-zA-Z0-9]', '_', 'g')), 50)"
_FILE_KEY = f"CASE WHEN length({_FILE_ID}) >= 50 THEN {_FILE_ID} || '_' || left(md5(file_id || '_' || doc_id || '.md'), 8) ELSE {_FILE_ID} END"
INGESTED_SQL = f"""WITH RECURSIVE {chunk_sql.families(file_id=_FILE_KEY)}, o AS (SELECT f.*, {_FILE_KEY.replace('file_id', 'x.file_id').replace('doc_id', 'x.doc_id')} AS file FROM f JOIN documents x USING (doc_id))
  SELECT chunk_id AS id, file AS file_id, parent_id, level, length(text) AS text_length, level = 1 AS embedded FROM o WHERE level = 0 OR ((length(text) >= 80 OR regexp_matches(text, '{_URL}')) AND regexp_matches(text, '[\\p{{L}}\\p{{N}}_]'))"""


def file_keywords(spark, d):
    """Keywords of each document as a file: frequent words, path, headings, addresses."""
    rows = _files(spark, d).where("text is not null")
    return rows.select("name", F.array_join(ingest.file_keywords(F.col("name"), F.col("raw"), F.col("text")), "|").alias("keywords"))


def chunk_keywords(spark, d):
    """Keywords of each chunk: its frequent words, its title and six words that stand for the file's."""
    rows = chunks_of(spark, d).where("text is not null")
    of_file = F.split(F.lit("alpha,beta,gamma,delta,epsilon,zeta,eta"), ",")
    return rows.select("id", F.array_join(ingest.chunk_keywords(F.col("text"), F.col("section_title"), of_file), "|").alias("keywords"))


_SANE = "list_filter({0}, lambda x: regexp_matches(x, '[a-zA-Z\\x{{0400}}-\\x{{04FF}}]') AND NOT contains(x, chr(65533)) AND NOT regexp_matches(x, '(?i)%[0-9a-f]{{2}}') AND length(x) - length(regexp_replace(x, '[\\x{{C0}}-\\x{{FF}}]', '', 'g')) <= 0.3 * length(regexp_replace(x, '\\s', '', 'g')) AND length(regexp_replace(x, '[\\w\\x{{0400}}-\\x{{04FF}}\\s\\-]', '', 'g')) <= 0.4 * length(regexp_replace(x, '\\s', '', 'g')))"
_ONCE = "(SELECT list_filter(z, lambda e, i: list_position(z, e) = i) FROM (SELECT {0} AS z))"


def _frequent_sql(source: str, key: str, most: int) -> str:
    """q: key and its most frequent words in order."""
    stop = "('" + "', '".join(FREQUENCY_STOP) + "')"
    return f"""fs AS (SELECT {key}, regexp_split_to_array(lower(text), '\\s+') AS l FROM {source} WHERE text IS NOT NULL), fw AS (SELECT {key}, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM fs),
  fc AS (SELECT {key}, word, count(*) AS n, min(pos) AS first FROM fw WHERE length(word) > 4 AND word NOT IN {stop} GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first) AS r FROM fc QUALIFY r <= {most}),
  q AS (SELECT {key}, list(word ORDER BY r) AS words FROM fr GROUP BY {key})"""


CHUNK_KEYWORDS_SQL = f"""WITH {_frequent_sql(CHUNKS, 'id', 12)}, t AS (SELECT c.id, list_concat(coalesce(words, []), CASE WHEN section_title IS NULL THEN [] ELSE list_concat([section_title], list_filter(regexp_split_to_array(section_title, '\\s+'), lambda w: length(w) > 2)) END, ['alpha', 'beta', 'gamma', 'delta', 'epsilon', 'zeta']) AS l
    FROM {CHUNKS} c LEFT JOIN q USING (id) WHERE c.text IS NOT NULL)
  SELECT id, array_to_string({_SANE.format(_ONCE.format('l'))}, '|') AS keywords FROM t"""


def _file_keywords_sql() -> str:
    """Frequent words, and the lists of the SQL of path, header and url keywords joined behind them."""
    split = "regexp_split_to_array({0}, '[./\\-_?&#=+:→\\[\\]()\\\\ |,\\s]')"
    keep = f"length(x) > 1 AND length(x) < 30 AND NOT regexp_matches(x, '^\\d+$') AND NOT regexp_matches(x, '(?i)%[0-9a-f]{{2}}') AND NOT regexp_matches(x, '^[a-z0-9]{{20,}}$') AND x NOT IN ('" + "', '".join(DOMAIN_STOP) + "')"
    heads = "regexp_extract_all(text, '(?m)^#{1,3}[ \\t]+([^\\n]+)$', 1)"
    head = f"list_filter(flatten(list_transform({heads}, lambda h: list_transform(regexp_split_to_array(regexp_replace(regexp_replace(h, '[*_`~]', '', 'g'), '([A-Z])', chr(1) || '\\1', 'g'), '[\\s\\-–—/|,;:()\\[\\]{{}}\\x01]+'), lambda w: lower(trim(w, ' '))))), lambda w: length(w) > 1)"
    path = "list_filter(list_transform(regexp_split_to_array(regexp_replace(file_id || '_' || doc_id, '([A-Z])', chr(1) || '\\1', 'g'), '[/\\\\\\s_\\-]+|\\x01'), lambda w: lower(w)), lambda w: length(w) > 2)"
    urls = f"""list_filter(list_transform(flatten(list_transform(list_concat(regexp_extract_all(text, 'https?://([^\\s"''<>]+)', 1), regexp_extract_all(regexp_replace(text, 'https?://[^\\s"''<>]+', ' ', 'g'), '\\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\\.){{1,5}}[a-zA-Z]{{2,10}}\\b')), lambda r: {split.format('r')})), lambda x: lower(trim(x, ' '))), lambda x: {keep})"""
    return f"""WITH {_frequent_sql('documents', 'doc_id', 15)}, t AS (SELECT file_id || '_' || doc_id || '.md' AS name, list_concat(coalesce(words, []), {_ONCE.format(path)}[1:10], {_ONCE.format(head)}[1:40], {_ONCE.format(urls)}[1:50]) AS l FROM documents LEFT JOIN q USING (doc_id) WHERE text IS NOT NULL)
  SELECT name, array_to_string({_SANE.format(_ONCE.format('l'))}, '|') AS keywords FROM t"""


def result_prompts(spark, d):
    """A prompt for each query from the texts of its shown results."""
    rows = table(spark, d, "search_results").where("text is not null").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "result_id"))).where("rank <= 7")
    said = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("context"))
    made = ask.prompt(F.concat(F.lit("query "), F.col("query_id")), F.col("context"))
    return said.select("query_id", F.md5(made.cast("binary")).alias("digest"))


PROMPT_SQL = """WITH r AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY pos, result_id) AS n FROM search_results WHERE text IS NOT NULL)
  SELECT query_id, md5('Context:' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || 'Question:' || chr(10) || 'query ' || query_id) AS digest FROM r WHERE n <= 7 GROUP BY query_id"""

QUERIES = {"hybrid_chunks": (hybrid_chunks, HYBRID_SQL), "hybrid_entity_chunks": _hybrid_in("entity"), "hybrid_precise_chunks": _hybrid_in("precise"), "hybrid_wide_chunks": _hybrid_in("wide", phrases=PHRASES)} | {
    f.__name__: (f, sql)
    for f, sql in [
        (nearest_chunks, NEAREST_SQL), (near_turns_by_threshold, f"""WITH q AS (SELECT query_id, vector::DOUBLE[] AS v FROM vector_queries WHERE {USABLE.format('vector')}), b AS (SELECT id, embedding::DOUBLE[] AS e FROM {TURNS} WHERE {USABLE.format('embedding')}),
          s AS (SELECT query_id, id, {_cosine_sql('v', 'e')} AS score FROM q, b) SELECT query_id, id, round(score, 5) AS score FROM s WHERE score >= 0.65 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 100"""),
        (vector_metrics, METRICS_SQL), (keyword_chunks, KEYWORD_SQL), (fused_results, FUSED_SQL), (merged_results, MERGED_SQL), (parent_contexts, PARENTS_SQL), (links_by_keywords, LINK_SEARCH_SQL), (link_scores, LINK_SCORE_SQL), (image_results, IMAGE_RESULTS_SQL), (image_matches, IMAGE_MATCHES_SQL),
        (graph_edges, f"WITH {GRAPH} SELECT src, dst, type FROM ed"), (graph_stats, f"WITH {GRAPH} SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM ed) AS edges, (SELECT count(*) FROM ent WHERE type = 'parent') AS parents, (SELECT count(*) FROM ent WHERE type = 'child') AS children"),
        (graph_neighbourhood, NEIGHBOURHOOD_SQL), (graph_matches, MATCHES_SQL), (extracted_entities, EXTRACTED_ENTITIES_SQL), (extracted_edges, EXTRACTED_EDGES_SQL), (rerank_scores, RERANK_SQL), (listwise_scores, LISTWISE_SQL), (compressed_answers, COMPRESS_SQL), (result_citations, CITATIONS_SQL), (answer_confidence, CONFIDENCE_SQL),
        (multi_query_chunks, MULTI_SQL), (adaptive_chunks, ADAPTIVE_SQL), (ingested_documents, INGESTED_SQL), (file_keywords, _file_keywords_sql()), (chunk_keywords, CHUNK_KEYWORDS_SQL), (result_prompts, PROMPT_SQL),
    ]
}
