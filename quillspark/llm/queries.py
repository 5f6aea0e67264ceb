"""Registry of the queries of this subpackage and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import bpe, canon, components, conversations, language, mixing, neardup, pairs, readability, splitting, vectors
from quillspark.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, asked = table(spark, sf_dir, "turns"), table(spark, sf_dir, "vector_queries")
    found = vectors.nearest(turns, "id", "embedding", asked, "query_id", "vector", k=10, size=96, out_id="turn_id")
    return found.select("query_id", "turn_id")


def p1_turn_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with a usable vector against all turns, without itself."""
    turns = table(spark, sf_dir, "turns").select("id", "embedding")
    found = vectors.nearest(turns, "id", "embedding", turns, "id", "embedding", k=10, size=96, out_id="turn_id", skip_self=True, half=True)
    return found.select("id", "turn_id", F.round("cosine", 4).alias("cosine"), "rank")


def _p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, record_kind, record_id, value of every label, keyword and query, and the reference terms (record_id null)."""
    turns, links = table(spark, sf_dir, "turns"), table(spark, sf_dir, "links")
    parts = [
        turns.select(F.lit("query").alias("kind"), F.lit("turn_query").alias("record_kind"), F.col("id").alias("record_id"), F.col("query").alias("value")),
        links.select(F.lit("label").alias("kind"), F.lit("link_label").alias("record_kind"), F.col("id").alias("record_id"), F.col("label").alias("value")),
        links.select(F.lit("keyword").alias("kind"), F.lit("link_keyword").alias("record_kind"), F.col("id").alias("record_id"), F.explode("keywords").alias("value")),
    ]
    records = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("reference", F.lit(False))
    terms = table(spark, sf_dir, "canon_terms").select("kind", F.lit(None).cast("string").alias("record_kind"), F.lit(None).cast("string").alias("record_id"), F.col("term").alias("value"), F.lit(True).alias("reference"))
    return canon.canonical(records.unionByName(terms), "kind", "value", "reference")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "canon_terms").select("term_id", F.col("kind").alias("k"), F.col("term").alias("t"))
    found = _p2_values(spark, sf_dir).where(F.col("record_id").isNotNull() & (F.col("value") != F.col("canonical")))
    # canon_terms is a fixed table of some 200 rows; Spark broadcasts it only below its threshold
    return found.join(terms, (F.col("kind") == F.col("k")) & (F.col("canonical") == F.col("t"))).select("record_kind", "record_id", "term_id").distinct()


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with the canonical member of its class."""
    found = _p2_values(spark, sf_dir).where(F.col("record_id").isNotNull() & F.col("value").isNotNull())
    return found.select("record_kind", "record_id", "value", "canonical").distinct()


def language_model(spark: SparkSession, sf_dir: str) -> language.Filter:
    """Fitted on a bounded sample of labelled documents and turns (question and answer)."""
    both = table(spark, sf_dir, "turns").select("id", "lang", F.concat_ws("\n", "query", "answer").alias("text"))
    docs = language.sample(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    turns = language.sample(both, "id", "text", "lang")
    return language.fit(docs[0] + turns[0], docs[1] + turns[1])


def _p3_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_kind, record_id, label, lang, confidence, languages, segments of every row with a text; rows delivered twice stay."""
    model = language_model(spark, sf_dir)
    parts = []
    for kind, name, key, text in (("document", "documents", "doc_id", "text"), ("chunk", "chunks", "id", "text"), ("turn", "turns", "id", "query")):
        rows = table(spark, sf_dir, name).select(F.lit(kind).alias("record_kind"), F.col(key).cast("string").alias("record_id"), language.label_language(F.col("lang")).alias("label"), F.col(text).alias("text"))
        parts.append(language.detect(rows, ["record_kind", "record_id", "label"], "text", model, open_end=kind == "turn"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _p3_detected(spark, sf_dir).where(F.col("lang").isNotNull())
    wrong = ~F.col("label").eqNullSafe(F.col("lang")) | (F.size("languages") > 1)
    return found.where(wrong).select("record_kind", "record_id", F.explode("languages").alias("lang")).distinct()


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every record with its language and confidence."""
    found = _p3_detected(spark, sf_dir).select("record_kind", "record_id", "lang", "confidence", F.explode_outer("segments").alias("s"))
    return found.select(
        "record_kind", "record_id", F.col("lang").alias("record_lang"), F.round("confidence", 4).alias("record_confidence"),
        F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.lang").alias("lang"), F.round("s.confidence", 4).alias("confidence"),
    ).distinct()


def _p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "split_options"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4_pieces(spark, sf_dir).where(F.col("piece_no") == 1).select("id", "field").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its place in the original."""
    found = _p4_pieces(spark, sf_dir).select("id", "field", "piece_no", "start_index", "piece", "limit", "overlap")
    return found.dropDuplicates(["id", "field", "piece_no"])


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cut value how many of its pieces are too long, not at their start_index, or don't share the overlap with the one before, and whether they cover all of it."""
    found = _p4_pieces(spark, sf_dir).select("id", "field", "piece_no", "start_index", "piece", "limit", "overlap").dropDuplicates(["id", "field", "piece_no"])
    values = table(spark, sf_dir, "chunks").select("id", F.explode(F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("value")), F.struct(F.lit("parent_text").alias("field"), F.col("parent_text").alias("value")))).alias("v")).select("id", "v.*").dropDuplicates(["id", "field"])
    w = Window.partitionBy("id", "field").orderBy("piece_no")
    end = F.col("start_index") + F.length("piece")
    rows = found.join(values, ["id", "field"]).withColumns({"__last": F.lag(end).over(w), "__end": end})
    own = F.substr("value", F.col("start_index") + 1, F.length("piece"))
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(False))).alias
    return rows.groupBy("id", "field").agg(
        bad(F.length("piece") > F.col("limit"))("too_long"), bad(F.col("piece") != own)("misplaced"), bad((F.col("__last") - F.col("start_index")) < F.least("overlap", "__last"))("unshared"),
        bad((F.col("piece_no") == 0) & (F.col("start_index") != 0))("late"), (F.max("__end") == F.max(F.length("value"))).alias("whole"),
    )


def p5_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect of every turn whose posterior exceeds the cutoff."""
    labelled = pairs.label(table(spark, sf_dir, "turns"), language_model(spark, sf_dir))
    return pairs.defects(labelled).groupBy("id", "defect").agg(F.round(F.max("posterior"), 4).alias("posterior"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = pairs.label(table(spark, sf_dir, "turns"), language_model(spark, sf_dir))
    return pairs.defects(labelled).groupBy("id").agg(F.min_by("defect", "order").alias("defect"))


def _p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (kind and id), block and text: chunks are one block, each result list is another."""
    chunks, results = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "search_results")
    chunk = F.struct(F.lit("chunk").alias("record_kind"), F.col("id").alias("id"))
    result = F.struct(F.lit("result").alias("record_kind"), F.col("result_id").alias("id"))
    flat = chunks.where(~F.col("level").eqNullSafe(F.lit(0))).select(chunk.alias("key"), F.lit(None).cast("bigint").alias("block"), "text")
    return flat.unionByName(results.select(result.alias("key"), F.col("query_id").alias("block"), "text"))


def _p6_joined(spark: SparkSession, sf_dir: str, t: float) -> tuple[DataFrame, DataFrame]:
    block = F.struct(F.col("key.record_kind"), F.col("block"))
    return neardup.near_duplicates(_p6_records(spark, sf_dir), "key", "text", block, width=3, min_words=20, t=t)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = _p6_joined(spark, sf_dir, 0.6)
    spread, hot = neardup.spread_members(members)
    between = neardup.with_members(neardup.with_members(links.select("a", "b"), "a", spread, hot, "ka"), "b", spread, hot, "kb").select("ka", "kb")
    within = neardup.with_members(members.select(F.col("key").alias("ka"), F.col("cls").alias("a")), "a", spread, hot, "kb").where("ka.id < kb.id").select("ka", "kb")
    pairs = between.unionByName(within)
    return pairs.select(F.col("ka.record_kind").alias("record_kind"), F.least("ka.id", "kb.id").alias("id_a"), F.greatest("ka.id", "kb.id").alias("id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its class, the number of links of the class, and its group (connected classes)."""
    links, members = _p6_joined(spark, sf_dir, 0.6)
    links = neardup.cut(links.select("a", "b"))
    groups = components.components(links, "a", "b").select(F.col("vertex").alias("cls"), "component")
    degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    joined = members.join(groups, "cls", "left").join(degree, "cls", "left")
    return joined.select("key.record_kind", "key.id", F.col("cls").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("group_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.rebuild(table(spark, sf_dir, "chat_messages"), with_text=False)
    return found.select(F.col("conv_id").alias("session_id"), "pos", "message_id")


def p7_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept conversations with one role per message."""
    return conversations.rebuild(table(spark, sf_dir, "chat_messages"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Tokens of an output shard of the registered mixtures, small enough for several shards at every scale of the test data.
P9_SHARD_TOKENS = 2**18


def _p9_sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.sized(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), table(spark, sf_dir, "source_weights")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chosen document of every mix, with its shard and place; a mix is as large as all documents, but for what caps take away."""
    return mixing.mixed(*_p9_sized(spark, sf_dir), "doc_id", shard_tokens=P9_SHARD_TOKENS)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares."""
    found = mixing.shares(*_p9_sized(spark, sf_dir), "doc_id", shard_tokens=P9_SHARD_TOKENS)
    return found.select(*(F.round(c, 6).alias(c) if c.endswith("_share") or c == "repeats" else F.round(c).cast("bigint").alias(c) if c in ("target_tokens", "reachable_tokens") else c for c in found.columns))


def p9_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every mix: shares within half a per cent of what caps allow, no cap exceeded, nothing chosen twice, places without gaps, no shard much larger than asked for.

    At scales under 0.01 a source has so few documents that its share can miss by more."""
    sized, weights = _p9_sized(spark, sf_dir)
    chosen = neardup.cut(mixing.mixed(sized, weights, "doc_id", shard_tokens=P9_SHARD_TOKENS))
    by_source = mixing.shares(sized, weights, "doc_id", shard_tokens=P9_SHARD_TOKENS).groupBy("mix_id").agg(
        F.min(F.abs(F.coalesce("actual_share", F.lit(0.0)) - F.coalesce("reachable_share", F.lit(0.0))) < 0.005).alias("shares_hold"),
        F.max(F.col("max_repeats").isNotNull() & F.coalesce(F.col("repeats") > F.greatest("max_repeats", F.lit(0)), F.lit(False))).alias("cap_exceeded"),
    )
    by_shard = chosen.groupBy("mix_id", "shard").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.sum("tokens").alias("t"), F.countDistinct("doc_id", "copy").alias("d"))
    by_mix = by_shard.groupBy("mix_id").agg(F.max(F.col("n") != F.col("d")).alias("repeated"), F.max(F.col("n") != F.col("last")).alias("gaps"), F.max(F.col("t") > 2 * P9_SHARD_TOKENS).alias("oversized"))
    return by_source.join(by_mix, "mix_id").select("mix_id", "shares_hold", "cap_exceeded", "repeated", "gaps", "oversized")


def _p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return readability.levels(docs, "doc_id", "text", table(spark, sf_dir, "reading_labels").select("doc_id", "band"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p10_levels(spark, sf_dir).where(F.col("band") != "standard").select("doc_id", "band")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade at the text's own sentence length, grade of its wording, and band of every document with running text."""
    return _p10_levels(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("grade", "word_grade")})


def queries() -> dict[str, Query]:
    names = (p1_found, p1_turn_neighbors, p2_found, p2_canonical, p3_found, p3_segments, p4_found, p4_pieces, p4_checks, p5_found, p5_defects, p6_found, p6_groups, p7_found, p7_messages, p8_ids, p9_mix, p9_shares, p9_balance, p10_found, p10_levels)
    return {q.__name__: q for q in names}


def _text_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _p2_sql(tail: str) -> str:
    """The same classes by DuckDB's own NFC instead of a collation."""
    letters = {a: b for a, b in canon.letter_map().items() if len(b) == 1}
    form = f"regexp_replace(value, {_text_literal('[' + chr(92) + 'p{Cf}' + canon.INVISIBLE + ']')}, '', 'g')"
    form = f"translate({form}, {_text_literal(''.join(letters))}, {_text_literal(''.join(letters.values()))})"
    for a, b in canon.ligatures().items():
        form = f"replace({form}, {_text_literal(a)}, {_text_literal(b)})"
    form = f"trim(regexp_replace({form}, '[ \t]+', ' ', 'g'), ' ')"
    return f"""
    WITH v AS (
      SELECT 'query' AS kind, 'turn_query' AS record_kind, id AS record_id, query AS value FROM turns
      UNION ALL SELECT 'label', 'link_label', id, label FROM links
      UNION ALL SELECT 'keyword', 'link_keyword', id, unnest(keywords) FROM links
      UNION ALL SELECT kind, NULL, NULL, term FROM canon_terms),
    f AS (SELECT *, nfc_normalize({form}) AS form FROM v WHERE value IS NOT NULL),
    n AS (SELECT kind, form, value, bool_or(record_id IS NULL) AS is_ref, count(*) AS n FROM f GROUP BY ALL),
    c AS (SELECT kind, form, first(value ORDER BY is_ref DESC, CASE WHEN is_ref THEN 0 ELSE -n END, value) AS canonical FROM n GROUP BY ALL)
    {tail}"""


def _p7_sql(columns: str) -> str:
    invisible = _text_literal("[\\s\\p{Z}\\p{Cc}\u2800\\p{Cf}" + canon.INVISIBLE + "]")
    return f"""
    WITH o AS (SELECT session_id, query, answer, ts, min(message_id) AS message_id, arg_min(coalesce(role, ''), message_id) AS role
      FROM chat_messages GROUP BY session_id, query, answer, ts),
    s AS (SELECT session_id AS conv_id, message_id, ts, coalesce(query, answer) AS text,
      CASE WHEN query IS NOT NULL THEN 'user' WHEN answer IS NOT NULL THEN 'assistant' WHEN lower(trim(role)) IN ('assistant', 'bot', 'ai') THEN 'assistant' ELSE 'user' END AS role
      FROM o WHERE NOT (query IS NULL AND answer IS NULL AND lower(trim(role)) = 'system')),
    p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM s
      WINDOW w AS (PARTITION BY conv_id ORDER BY ts NULLS FIRST, role DESC, message_id)),
    j AS (SELECT *, bool_or(coalesce(regexp_replace(text, {invisible}, '', 'g'), '') = '' OR role <> CASE WHEN pos % 2 = 1 THEN 'user' ELSE 'assistant' END OR n % 2 = 1)
      OVER (PARTITION BY conv_id) AS broken FROM p)
    SELECT {columns} FROM j WHERE NOT broken"""


P4_FOUND_SQL = """
    WITH o AS (SELECT file_id, arg_max(struct_pack(p := parent_size, c := child_size, v := overlap), updated_at) AS o FROM split_options GROUP BY file_id),
    l AS (SELECT c.*, coalesce(o.p, 4000) AS parent_limit, coalesce(o.c, 1200) AS child_limit, coalesce(o.v, 150) AS lap
      FROM chunks c LEFT JOIN o USING (file_id))
    SELECT DISTINCT id, 'text' AS field FROM l WHERE lap < child_limit AND length(text) > CASE WHEN level = 0 THEN parent_limit ELSE child_limit END
    UNION SELECT id, 'parent_text' FROM l WHERE lap < child_limit AND length(parent_text) > parent_limit"""


P6_FOUND_SQL = r"""
    WITH r AS (SELECT DISTINCT 'chunk' AS k, NULL::BIGINT AS b, id, text FROM chunks WHERE level IS DISTINCT FROM 0 UNION ALL SELECT 'result', query_id, result_id, text FROM search_results),
    w AS (SELECT k, b, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM r WHERE text IS NOT NULL),
    s AS (SELECT DISTINCT k, b, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
    n AS (SELECT k, id, count(*) AS n FROM s GROUP BY ALL),
    p AS (SELECT x.k, x.id AS a, y.id AS z, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.k = y.k AND x.b IS NOT DISTINCT FROM y.b AND x.id < y.id GROUP BY ALL)
    SELECT p.k AS record_kind, a AS id_a, z AS id_b FROM p JOIN n u ON u.k = p.k AND u.id = a JOIN n v ON v.k = p.k AND v.id = z WHERE c >= 0.6 * (u.n + v.n - c) - 1e-9"""
P4_CHECKS_SQL = f"SELECT id, field, 0 AS too_long, 0 AS misplaced, 0 AS unshared, 0 AS late, true AS whole FROM ({P4_FOUND_SQL})"


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": P4_FOUND_SQL,
        "p4_checks": P4_CHECKS_SQL,
        "p6_found": P6_FOUND_SQL.replace("\\\\", "\\"),
        "p9_balance": "SELECT DISTINCT mix_id, true AS shares_hold, false AS cap_exceeded, false AS repeated, false AS gaps, false AS oversized FROM source_weights WHERE mix_id IS NOT NULL",
        "p7_found": _p7_sql("conv_id AS session_id, pos, message_id"),
        "p7_messages": _p7_sql("conv_id, pos, message_id, role, text, ts"),
        "p2_found": _p2_sql("SELECT DISTINCT record_kind, record_id, term_id FROM f JOIN c USING (kind, form) JOIN canon_terms t ON t.kind = f.kind AND t.term = canonical WHERE record_id IS NOT NULL AND value <> canonical"),
        "p2_canonical": _p2_sql("SELECT DISTINCT record_kind, record_id, value, canonical FROM f JOIN c USING (kind, form) WHERE record_id IS NOT NULL"),
    }
