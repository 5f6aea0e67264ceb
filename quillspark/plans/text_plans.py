"""Queries on texts and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import names, text as T
from quillspark.functions.fixed import ABBREVIATIONS, LINK_STOP, NAME_ENDINGS, POPULAR
from quillspark.operators import chunking, links as L, understanding
from quillspark.plans import chunk_sql
from quillspark.session import table

SEPARATOR = "\u0002"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def digest(c: str):
    return F.md5(F.col(c).cast("binary"))


def encoding_gate(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    share = T.bad_character_share(F.col("text"))
    return docs.select("doc_id", F.round(share, 6).alias("bad_share"), (share <= 0.05).alias("accepted"))


ENCODING_SQL = """SELECT doc_id, round(s, 6) AS bad_share, s <= 0.05 AS accepted FROM (SELECT doc_id,
  (length(text) - length(regexp_replace(text, '[\\x{FFFD}\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'))) / greatest(length(text), 1) AS s FROM documents WHERE text IS NOT NULL)"""


def normalized_text(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.normalize_text(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").alias("length"), digest("t").alias("digest"))


def _norm_sql(x: str) -> str:
    x = f"regexp_replace(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


NORMALIZED_SQL = f"SELECT doc_id, length(t) AS length, md5(t) AS digest FROM (SELECT doc_id, {_norm_sql('text')} AS t FROM documents WHERE text IS NOT NULL)"


def stripped_markdown(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.strip_markdown(F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").alias("length"), digest("t").alias("digest"))


def _strip_sql() -> str:
    x = "text"
    for p, new in [
        (r"(?m)^#{1,6}[ \t]+([^\n]*[^\s])[ \t]*$", "\n[\\1]"), (r"(?s)```.*?```", ""), (r"`([^`]+)`", "\\1"), (r"!\[[^\n]*?\]\([^\n]*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "\\1"), (r"\*\*|__|\*|_", ""),
        (r"(?m)^\|[-:| ]+\|$", ""), (r"(?m)^\|(\s*\|)+[ \t]*$", ""), (r"(?m)^\|[ \t]*([^\n]+?)[ \t]*\|$", "\\1"), (r"(?m)[ \t]*\|[ \t]*", " | "),
    ]:
        x = f"regexp_replace({x}, {lit(p)}, {lit(new)}, 'g')"
    return _norm_sql(x)


STRIPPED_SQL = f"SELECT doc_id, length(t) AS length, md5(t) AS digest FROM (SELECT doc_id, {_strip_sql()} AS t FROM documents WHERE text IS NOT NULL)"


def word_counts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("words"))


WORDS_SQL = r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL"


def sentences(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", SEPARATOR).cast("binary")).alias("digest"))


SENTENCES_SQL = f"""SELECT doc_id, len(s) AS sentences, md5(array_to_string(s, {lit(SEPARATOR)})) AS digest FROM (SELECT doc_id,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(?i)\\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|e\\.g|i\\.e|Ph\\.D|M\\.D|B\\.A|M\\.A)\\.', '\\1' || chr(1), 'g'), '([.!?])\\s+([A-ZА-ЯІЇЄҐ])', '\\1' || chr(3) || '\\2', 'g'), chr(3)),
  lambda x: trim(replace(x, chr(1), '.'), ' ')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)"""


def sections(spark, d):
    found = chunking.sections(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return found.select("doc_id", "pos", "header", digest("body").alias("digest"))


SECTIONS_SQL = r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(#{1,2}[ \t]+\S)', chr(1) || '\1', 'g'), chr(1)),
  lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
  e AS (SELECT doc_id, unnest(range(len(l))) AS i, l FROM p)
  SELECT doc_id, i AS pos, CASE WHEN regexp_matches(l[i + 1], '^#{1,2}[ \t]+\S') THEN trim(string_split(l[i + 1], chr(10))[1], ' ') END AS header, md5(l[i + 1]) AS digest FROM e"""


def file_ids(spark, d):
    return table(spark, d, "links").select("source_file").distinct().select("source_file", T.file_id(F.col("source_file")).alias("file_id"))


FILE_IDS_SQL = "SELECT DISTINCT source_file, left(lower(regexp_replace(regexp_replace(source_file, '(?i)\\.md$', ''), '[^a-zA-Z0-9]', '_', 'g')), 50) AS file_id FROM links"


def sane_keywords(spark, d):
    rows = table(spark, d, "links").where("keywords is not null").dropDuplicates(["id"])
    return rows.select("id", F.array_join(T.sane_keywords(F.col("keywords")), SEPARATOR).alias("kept"), (F.size("keywords") - F.size(T.sane_keywords(F.col("keywords")))).alias("dropped"))


SANE_SQL = f"""WITH k AS (SELECT id, keywords, list_filter(keywords, lambda x: regexp_matches(x, '[a-zA-Z\\x{{0400}}-\\x{{04FF}}]') AND NOT contains(x, chr(65533)) AND NOT regexp_matches(x, '(?i)%[0-9a-f]{{2}}')
    AND length(x) - length(regexp_replace(x, '[\\x{{C0}}-\\x{{FF}}]', '', 'g')) <= 0.3 * length(regexp_replace(x, '\\s', '', 'g'))
    AND length(regexp_replace(x, '[\\w\\x{{0400}}-\\x{{04FF}}\\s\\-]', '', 'g')) <= 0.4 * length(regexp_replace(x, '\\s', '', 'g'))) AS kept FROM (SELECT DISTINCT ON (id) * FROM links) WHERE keywords IS NOT NULL)
  SELECT id, array_to_string(kept, {lit(SEPARATOR)}) AS kept, len(keywords) - len(kept) AS dropped FROM k"""


def header_keywords(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(T.header_keywords(F.col("text")), SEPARATOR).alias("keywords"))


HEADER_SQL = f"""WITH h AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '(?m)^#{{1,3}}[ \\t]+([^\\n]+)$', 1), [''])) AS h, generate_subscripts(list_concat(regexp_extract_all(text, '(?m)^#{{1,3}}[ \\t]+([^\\n]+)$', 1), ['']), 1) AS i FROM documents WHERE text IS NOT NULL),
  w AS (SELECT doc_id, i, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(h, '[*_`~]', '', 'g'), '([A-Z])', chr(1) || '\\1', 'g'), '[\\s\\-–—/|,;:()\\[\\]{{}}\\x01]+'), lambda x: lower(trim(x, ' '))), lambda x: length(x) > 1) AS l FROM h),
  a AS (SELECT doc_id, flatten(list(l ORDER BY i)) AS l FROM w GROUP BY doc_id)
  SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:40], {lit(SEPARATOR)}) AS keywords FROM a"""


def url_keywords(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(F.array_sort(T.url_keywords(F.col("text"), 1000)), SEPARATOR).alias("keywords"))


def _url_keywords_sql() -> str:
    parts = "regexp_split_to_array({0}, '[./\\-_?&#=+:→\\[\\]()\\\\ |,\\s]')"
    keep = f"length(x) > 1 AND length(x) < 30 AND NOT regexp_matches(x, '^\\d+$') AND NOT regexp_matches(x, '(?i)%[0-9a-f]{{2}}') AND NOT regexp_matches(x, '^[a-z0-9]{{20,}}$') AND x NOT IN ({', '.join(map(lit, T.DOMAIN_STOP))})"
    return f"""WITH u AS (SELECT doc_id, regexp_extract_all(text, 'https?://([^\\s"''<>]+)', 1) AS a, regexp_extract_all(regexp_replace(text, 'https?://[^\\s"''<>]+', ' ', 'g'), '\\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?\\.){{1,5}}[a-zA-Z]{{2,10}}\\b') AS b FROM documents WHERE text IS NOT NULL),
  k AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(list_concat(a, b), lambda r: {parts.format('r')})), lambda x: lower(trim(x, ' '))), lambda x: {keep}) AS l FROM u)
  SELECT doc_id, array_to_string(list_sort(list_distinct(l)), {lit(SEPARATOR)}) AS keywords FROM k"""


def frequency_keywords(spark, d):
    """The 15 most frequent longer words of each whole document, counted within the row."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(T.frequent_words(F.col("text"))).alias("rank", "w")).select("doc_id", "w.word", "w.n", (F.col("rank") + 1).alias("rank"))


FREQUENCY_SQL = r"""WITH s AS (SELECT doc_id, regexp_split_to_array(lower(text), '\s+') AS l FROM documents WHERE text IS NOT NULL),
  w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM s),
  c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE length(word) > 4 AND word NOT IN ('який', 'якщо', 'також', 'this', 'that', 'which') GROUP BY ALL)
  SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c QUALIFY rank <= 15"""


def path_keywords(spark, d):
    return table(spark, d, "links").select("source_file").distinct().select("source_file", F.array_join(T.path_keywords(F.col("source_file")), " ").alias("keywords"))


PATH_SQL = r"""WITH p AS (SELECT DISTINCT source_file, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(source_file, '(?i)\.md$', ''), '([A-Z])', chr(1) || '\1', 'g'), '[/\\\s_\-]+|\x01'), lambda x: lower(x)), lambda x: length(x) > 2) AS l FROM links)
  SELECT source_file, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:10], ' ') AS keywords FROM p"""


def question_keywords(spark, d):
    turns = table(spark, d, "turns").where("query is not null").dropDuplicates(["id"])
    return turns.select("id", F.array_join(T.query_keywords(F.col("query")), " ").alias("keywords"))


QUESTION_SQL = f"""WITH p AS (SELECT id, list_filter(regexp_split_to_array(regexp_replace(lower(query), '[?!.,;:''"]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({', '.join(map(lit, T.QUERY_STOP))})) AS l FROM (SELECT DISTINCT ON (id) * FROM turns) WHERE query IS NOT NULL)
  SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:15], ' ') AS keywords FROM p"""


def latin_spelling(spark, d):
    rows = table(spark, d, "links").where("label is not null").select("label").distinct()
    return rows.select("label", T.to_latin(F.col("label")).alias("latin"), T.to_cyrillic(F.col("label")).alias("cyrillic"))


def _latin_sql(x: str) -> str:
    x = f"lower({x})"
    for a, b in T.TO_LATIN.items():
        if len(b) != 1:
            x = f"replace({x}, '{a}', '{b}')"
    single = {a: b for a, b in T.TO_LATIN.items() if len(b) == 1}
    return f"translate({x}, '{''.join(single)}', '{''.join(single.values())}')"


def _cyrillic_sql(x: str) -> str:
    x = f"lower({x})"
    for a, b in T.TO_CYRILLIC:
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_replace(translate({x}, '{T.SINGLE_LATIN}', '{T.SINGLE_CYRILLIC}'), '[a-z]', '', 'g')"


LATIN_SQL = f"SELECT DISTINCT label, {_latin_sql('label')} AS latin, {_cyrillic_sql('label')} AS cyrillic FROM links WHERE label IS NOT NULL"


def name_variants(spark, d):
    """Spellings of the capitalised words of each question."""
    turns = table(spark, d, "turns").where("query is not null").dropDuplicates(["id"])
    return turns.select("id", F.array_join(F.array_sort(names.query_name_variants(F.col("query"))), " ").alias("variants"))


def names_sql(key: str) -> str:
    """Common table expressions from o (key and a name o in small letters) to v (key, w): all spellings of each name.

    Each rule is a case of its own; what stands before a rewritten ending or h is kept.
    """
    rules = [("([^sckzgdt]|^)h" if g == "h" else f"()({g})", new) for g, spellings in POPULAR.items() for new in spellings]
    rules += [("()(i[iy])$", e) for e in names.ADJECTIVE] + [("()(hi[iy])$", "g" + e) for e in names.ADJECTIVE_G] + [("(.{2}[^i])y$", e) for e in names.SHORT_Y]
    latin = [f"CASE WHEN regexp_matches(l, {lit(p)}) THEN regexp_replace(l, {lit(p)}, {lit(chr(92) + '1' + new)}, 'g') END" for p, new in rules]
    stems = [f"CASE WHEN regexp_matches(c, {lit('.{3}' + e + '$')}) THEN regexp_replace(c, {lit(e + '$')}, '') END" for e in NAME_ENDINGS]
    return f"""b AS (SELECT {key}, o, CASE WHEN regexp_matches(o, '[^a-z]') THEN {_latin_sql('o')} ELSE o END AS l, CASE WHEN regexp_matches(o, '[^a-z]') THEN o ELSE {_cyrillic_sql('o')} END AS c FROM o WHERE length(o) >= 2),
  s AS (SELECT *, list_filter([{', '.join(stems)}], lambda x: x IS NOT NULL) AS stems FROM b),
  v AS (SELECT DISTINCT {key}, w FROM (SELECT {key}, unnest(list_concat([o, l, c], [{', '.join(latin)}], stems, list_transform(stems, lambda x: {_latin_sql('x')}))) AS w FROM s) WHERE length(w) >= 2)"""


NAMES_SQL = f"""WITH t AS (SELECT id, unnest(list_append(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: regexp_matches(x, '^[А-ЯІЇЄҐA-Z]') AND length(x) >= 2), '')) AS t FROM (SELECT DISTINCT ON (id) * FROM turns) WHERE query IS NOT NULL),
  o AS (SELECT id, CASE WHEN length(p) >= 3 THEN regexp_replace(p, '[^a-zа-яіїєґё]', '', 'g') ELSE '' END AS o FROM (SELECT id, unnest(regexp_split_to_array(lower(t), '[{chunk_sql.BLANK}]+')) AS p FROM t)), {names_sql('id')},
  k AS (SELECT id, list(w ORDER BY w) AS l FROM (SELECT id, w FROM v UNION SELECT id, lower(t) FROM t WHERE t <> '') GROUP BY id)
  SELECT i.id, coalesce(array_to_string(l, ' '), '') AS variants FROM (SELECT DISTINCT id FROM t) i LEFT JOIN k USING (id)"""


def stems(spark, d):
    """The words of all questions with Cyrillic letters, whatever their label."""
    words = table(spark, d, "turns").where(F.col("query").rlike("[а-яА-ЯіїєґІЇЄҐ]")).select(F.explode(F.split(F.lower("query"), r"[^\p{L}]+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


def _stem_sql() -> str:
    cases = " ".join(f"WHEN word LIKE '%{e}' AND length(word) - {len(e)} >= 3 THEN left(word, length(word) - {len(e)})" for e in T.ENDINGS)
    return f"SELECT word, CASE WHEN length(word) <= 4 THEN word {cases} ELSE word END AS stem FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(query), '[^\\p{{L}}]+')) AS word FROM turns WHERE regexp_matches(query, '[а-яА-ЯіїєґІЇЄҐ]')) WHERE word <> ''"


#: Patterns of a caller: attempts to override instructions, and requests for links.
OVERRIDES = [r"(forget|drop) (your|the) (rules|instructions)", r"\bpretend to be\b", r"hidden (prompt|instructions)"]
LINK_WISHES = [r"\b(link|url|address|page)\b", r"посилання|адрес|сторінк|страниц", r"\b(odnośnik|strona|seite)\b", r"which file|який файл|какой файл|który plik|welche datei"]


def question_traits(spark, d):
    """Guards and detectors on each question."""
    turns = table(spark, d, "turns").where("query is not null").dropDuplicates(["id"])
    q = F.col("query")
    return turns.select("id", T.holds_any(q, OVERRIDES).alias("unsafe"), T.holds_any(q, LINK_WISHES).alias("asks_link"), T.latin_majority(q).alias("latin"))


TRAITS_SQL = f"""SELECT id, regexp_matches(lower(query), {lit('(?i)' + '|'.join(OVERRIDES))}) AS unsafe, regexp_matches(lower(query), {lit('(?i)' + '|'.join(LINK_WISHES))}) AS asks_link,
  coalesce((length(query) - length(regexp_replace(query, '[a-zA-Z]', '', 'g'))) / nullif(length(query) - length(regexp_replace(query, '[a-zA-Zа-яіїєґёэъыА-ЯІЇЄҐ]', '', 'g')), 0) > 0.5, false) AS latin
  FROM (SELECT DISTINCT ON (id) * FROM turns) WHERE query IS NOT NULL"""


def negation(spark, d):
    turns = table(spark, d, "turns").where("query is not null").dropDuplicates(["id"]).select("id", T.negation(F.col("query")).alias("n"))
    return turns.select("id", F.array_join("n.include", " ").alias("include"), F.array_join("n.exclude", " ").alias("exclude"))


NEGATION_SQL = r"""WITH s AS (SELECT id, list_filter(list_transform(regexp_split_to_array(lower(query), '\s+'), lambda x: regexp_replace(x, '[^a-z]', '', 'g')), lambda x: x <> '') AS l FROM (SELECT DISTINCT ON (id) * FROM turns) WHERE query IS NOT NULL)
  SELECT id, array_to_string(list_filter(l, lambda x, i: x <> 'not' AND NOT (i > 1 AND l[i - 1] = 'not')), ' ') AS include, array_to_string(list_filter(l, lambda x, i: x <> 'not' AND i > 1 AND l[i - 1] = 'not'), ' ') AS exclude FROM s"""


def sanitized_answers(spark, d):
    turns = table(spark, d, "turns").where("answer is not null").dropDuplicates(["id"])
    return turns.select("id", T.sanitize_output(F.col("answer")).alias("t")).select("id", digest("t").alias("digest"))


SANITIZED_SQL = r"""SELECT id, md5(trim(regexp_replace(regexp_replace(answer, '(?i)</?(linksResult|linkResults|links_usage_rules)>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS digest FROM (SELECT DISTINCT ON (id) * FROM turns) WHERE answer IS NOT NULL"""


def url_kinds(spark, d):
    rows = table(spark, d, "links").where("url is not null").select("url").distinct()
    return rows.select("url", T.valid_url(F.col("url")).alias("valid"), T.link_type(F.col("url")).alias("kind"))


URL_SQL = r"""SELECT DISTINCT url, regexp_matches(url, '^https?://') AND contains(regexp_extract(url, '^https?://([^/?#:]+)', 1), '.') AS valid,
  CASE WHEN regexp_matches(url, '(?i)\.(png|jpe?g|gif|webp|svg|ico|bmp)(\?.*)?$') THEN 'image' WHEN regexp_matches(url, '(?i)\.(mp4|webm|mov|avi|mkv)(\?.*)?$|youtu\.?be|vimeo\.com|loom\.com|wistia\.com') THEN 'video' ELSE 'url' END AS kind
  FROM links WHERE url IS NOT NULL"""


def id_distance(spark, d):
    rows = table(spark, d, "chunks").where("parent_id is not null and chunk_id is not null").select("chunk_id", "parent_id").distinct()
    return rows.select("chunk_id", "parent_id", F.levenshtein("chunk_id", "parent_id").alias("distance"))


DISTANCE_SQL = "SELECT DISTINCT chunk_id, parent_id, levenshtein(chunk_id, parent_id) AS distance FROM chunks WHERE parent_id IS NOT NULL AND chunk_id IS NOT NULL"


#: A caller's rules: kind, pattern, and what must not occur.
KIND_RULES = [
    ("factual", r"^(when|how many|how long|коли|скільки|сколько|когда|kiedy|ile|wann|wie viele)", None),
    ("wide", r"^(describe|explain|summarize|опиши|поясни|объясни|opisz|wyjaśnij|beschreibe)", r"\d"),
    ("entity", r"^(who|хто|кто|kto|wer) ", None),
    ("wide", r"^(what|що|что|co|was)\s+\S+(\s+\S+)?$", None),
]


def question_kinds(spark, d):
    """Kind by rules, else by a model's answer (here the label of the language), and the kind's profile."""
    turns = table(spark, d, "turns").where("query is not null").dropDuplicates(["id"])
    said = F.when(F.col("lang") == "en", F.lit('Sure: {"type": "wide", "confidence": 0.9}')).when(F.col("lang") == "de", F.lit('{"type": "poem"}')).otherwise(F.lit("no idea"))
    found = understanding.classified(turns.select("id", "query", said.alias("said")), "query", KIND_RULES, "said", LINK_WISHES)
    return understanding.with_profile(found.select("id", "kind", "confidence", "search_mode"), "kind")


def _kinds_sql() -> str:
    rules = " ".join(f"WHEN regexp_matches(p, {lit(pattern)}){'' if barred is None else f' AND NOT regexp_matches(query, {lit(barred)})'} THEN {lit(kind)}" for kind, pattern, barred in KIND_RULES)
    return f"""WITH t AS (SELECT id, query, lang, trim(regexp_replace(lower(trim(query, ' ')), '[?!.,;:]', '', 'g'), ' ') AS p, regexp_matches(lower(query), {lit('(?i)' + '|'.join(LINK_WISHES))}) AS link FROM (SELECT DISTINCT ON (id) * FROM turns) WHERE query IS NOT NULL),
  r AS (SELECT *, CASE {rules} END AS ruled FROM t), k AS (SELECT id, link, coalesce(ruled, CASE WHEN lang = 'en' THEN 'wide' ELSE 'factual' END) AS kind, CASE WHEN ruled IS NOT NULL THEN 1.0 WHEN lang = 'en' THEN 0.9 ELSE 0.5 END AS confidence FROM r),
  f AS (SELECT * FROM (VALUES ('entity', 16, 0.35, 'entity', 'hybrid', true, 0.0, 1.0, 5, 10000, NULL), ('factual', 15, 0.45, 'balanced', 'listwise_llm', false, 0.3, 0.85, 20, 3200, 1.1), ('wide', 12, 0.38, 'wide', 'hybrid', true, 0.3, 1.0, 2, 7200, 1.2))
    AS v(kind, "limit", threshold, mode, rerank_strategy, use_graph, temperature, top_p, top_k, max_tokens, repeat_penalty))
  SELECT id, confidence, CASE WHEN link THEN 'entity' ELSE mode END AS search_mode, f.* FROM k JOIN f USING (kind)"""


SYNONYMS = {"sick": ["лікарняний", "sick leave"], "відпустк": ["vacation", "days off"], "training": ["навчання", "courses"], "навчан": ["training"], "графік": ["schedule"], "sick note": ["medical leave"]}
TRANSLATIONS = [(r"sick.{0,10}(leave|note)", "лікарняний"), (r"onboarding", "онбординг"), (r"tell.{0,10}(me|us).{0,10}about", "розкажи про")]


def expanded_questions(spark, d):
    turns = table(spark, d, "turns").where("query is not null").dropDuplicates(["id"])
    q = F.col("query")
    return turns.select("id", F.array_join(F.array_sort(understanding.expand(q, SYNONYMS)), SEPARATOR).alias("words"), F.array_join(understanding.translations(q, TRANSLATIONS), SEPARATOR).alias("translations"))


def _expanded_sql() -> str:
    stem = "CASE WHEN length(w) <= 4 THEN w " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) - {len(e)} >= 3 THEN left(w, length(w) - {len(e)})" for e in T.ENDINGS) + " ELSE w END"
    fits = lambda k: f"contains(q, {lit(k)})" if " " in k else f"len(list_filter(l, lambda w: starts_with(w, {lit(k)}) OR starts_with({stem}, {lit(k)}) OR starts_with({lit(k)}, {stem}))) > 0"
    more = ", ".join(f"CASE WHEN {fits(k)} THEN [{', '.join(lit(v.lower()) for v in vs)}] ELSE [] END" for k, vs in SYNONYMS.items())
    told = ", ".join(f"CASE WHEN regexp_matches(query, {lit('(?i)' + p)}) THEN {lit(v)} END" for p, v in TRANSLATIONS)
    latin = "coalesce((length(query) - length(regexp_replace(query, '[a-zA-Z]', '', 'g'))) / nullif(length(query) - length(regexp_replace(query, '[a-zA-Zа-яіїєґёэъыА-ЯІЇЄҐ]', '', 'g')), 0) > 0.5, false)"
    return f"""WITH q AS (SELECT id, query, regexp_replace(lower(query), '[?!.,;:]', '', 'g') AS q FROM (SELECT DISTINCT ON (id) * FROM turns) WHERE query IS NOT NULL),
  w AS (SELECT *, list_filter(list_transform(regexp_split_to_array(q, '\\s+'), lambda x: regexp_replace(x, '[^a-zа-яіїєґёэъы0-9.\\-]', '', 'g')), lambda x: length(x) > 2) AS l FROM q)
  SELECT id, array_to_string(list_sort(list_distinct(list_filter(flatten([l, {more}]), lambda x: length(x) > 2))), {lit(SEPARATOR)}) AS words,
    CASE WHEN {latin} THEN array_to_string(list_filter([{told}], lambda x: x IS NOT NULL), {lit(SEPARATOR)}) ELSE '' END AS translations FROM w"""


def document_links(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    found = L.extract(docs, "doc_id", "text")
    return found.select("doc_id", "url", "label", "link_type", "context", F.array_join(L.keywords(F.col("label"), F.col("url"), F.col("context")), " ").alias("keywords"))


LINKS_SQL = r"""WITH f AS (
    SELECT doc_id, 0 AS form, unnest(regexp_extract_all(text, '!\[([^\]]*)\]\(([^)]+)\)')) AS m, NULL AS u FROM documents
    UNION ALL SELECT doc_id, 1, unnest(regexp_extract_all(' ' || text, '[^!]\[([^\]]+)\]\(([^)]+)\)')), NULL FROM documents
    UNION ALL SELECT doc_id, 2, NULL, unnest(regexp_extract_all(text, '<(https?://[^>]+)>', 1)) FROM documents
    UNION ALL SELECT doc_id, 3, NULL, unnest(regexp_extract_all(' ' || text, '[^(\["''](https?://[^\s"''<>)\[\]]+)', 1)) FROM documents),
  g AS (SELECT doc_id, form, trim(coalesce(u, regexp_extract(m, '\]\(([^)]+)\)', 1)), ' ') AS url, trim(coalesce(u, CASE WHEN form = 0 AND regexp_extract(m, '\[([^\]]*)\]', 1) = '' THEN 'image' ELSE regexp_extract(m, '\[([^\]]*)\]', 1) END), ' ') AS label FROM f),
  h AS (SELECT doc_id, url, max_by(CASE WHEN label = url THEN '' ELSE label END, [length(CASE WHEN label = url THEN '' ELSE label END), -form]) AS label FROM g WHERE url <> '' AND NOT starts_with(url, '#') AND NOT starts_with(url, 'mailto:') GROUP BY ALL)
  SELECT doc_id, url, CASE WHEN label = '' THEN url ELSE label END AS label FROM h"""


def _document_links_sql() -> str:
    squeeze = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ')"
    tokens = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[\\s\\-_/|,;:()\\[\\]{{}}!?.''\"<>]+'), lambda w: length(w) > 1 AND NOT regexp_matches(w, '^\\d+$') AND w NOT IN ({', '.join(map(lit, LINK_STOP))}))"
    known = "MAP {" + ", ".join(f"{lit(k)}: [{', '.join(map(lit, v))}]" for k, v in ABBREVIATIONS.items()) + "}"
    once = lambda x: f"(SELECT list_filter(z, lambda e, i: list_position(z, e) = i) FROM (SELECT {x} AS z))"
    spelled = lambda x: once(f"flatten(list_transform({x}, lambda w: list_concat([w], coalesce({known}[w], []))))")
    return rf"""WITH f AS (
    SELECT doc_id, text, 0 AS form, unnest(regexp_extract_all(text, '!\[([^\]]*)\]\(([^)]+)\)')) AS m, generate_subscripts(regexp_extract_all(text, '!\[([^\]]*)\]\(([^)]+)\)'), 1) AS n FROM documents
    UNION ALL SELECT doc_id, text, 1, substr(unnest(l), 2), generate_subscripts(l, 1) FROM (SELECT doc_id, text, regexp_extract_all(' ' || text, '[^!]\[([^\]]+)\]\(([^)]+)\)') AS l FROM documents)
    UNION ALL SELECT doc_id, text, 2, unnest(l), generate_subscripts(l, 1) FROM (SELECT doc_id, text, regexp_extract_all(text, '<https?://[^>]+>') AS l FROM documents)
    UNION ALL SELECT doc_id, text, 3, unnest(l), generate_subscripts(l, 1) FROM (SELECT doc_id, text, regexp_extract_all(' ' || text, '[^(\["''](https?://[^\s"''<>)\[\]]+)', 1) AS l FROM documents)),
  g AS (SELECT doc_id, text, form, n, position(m IN text) - 1 AS place, trim(CASE WHEN form < 2 THEN regexp_extract(m, '\]\(([^)]+)\)', 1) ELSE regexp_replace(m, '^<|>$', '', 'g') END, ' ') AS url,
    trim(CASE WHEN form = 0 AND regexp_extract(m, '\[([^\]]*)\]', 1) = '' THEN 'image' WHEN form < 2 THEN regexp_extract(m, '\[([^\]]*)\]', 1) ELSE regexp_replace(m, '^<|>$', '', 'g') END, ' ') AS label FROM f),
  h AS (SELECT * REPLACE (CASE WHEN label = url THEN '' ELSE label END AS label) FROM g WHERE url <> '' AND NOT starts_with(url, '#') AND NOT starts_with(url, 'mailto:') QUALIFY row_number() OVER (PARTITION BY doc_id, url ORDER BY length(CASE WHEN label = url THEN '' ELSE label END) DESC, form, n) = 1),
  p AS (SELECT *, {squeeze("regexp_split_to_array(left(text, place), '\n[ \t\r]*\n')[-1] || regexp_split_to_array(substr(text, place + 1), '\n[ \t\r]*\n')[1]")} AS par, {squeeze("substr(text, greatest(place - 150, 0) + 1, place - greatest(place - 150, 0) + 150)")} AS win FROM h),
  c AS (SELECT doc_id, url, CASE WHEN label = '' THEN url ELSE label END AS label, CASE WHEN length(par) BETWEEN 20 AND 600 THEN left(par, 300) ELSE win END AS near FROM p),
  o AS (SELECT *, {spelled(rf"list_concat({tokens('label')}, list_transform(list_concat(list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1), '.'), lambda w: length(w) > 2 AND w NOT IN ('com', 'net', 'org', 'app', 'dev', 'www')), list_filter(regexp_split_to_array(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '[/\-_?&#=+]'), lambda w: length(w) > 2 AND NOT regexp_matches(w, '^\d+$'))), lambda w: lower(w)))")} AS own FROM c),
  r AS (SELECT *, list_filter({tokens('near')}, lambda w: NOT list_contains(own, w)) AS rest FROM o),
  k AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(rest), lambda w: struct_pack(n := -len(list_filter(rest, lambda x: x = w)), p := list_position(rest, w), w := w)))[1:15], lambda s: s.w) AS top FROM r)
  SELECT doc_id, url, label, CASE WHEN regexp_matches(url, '(?i)\.(png|jpe?g|gif|webp|svg|ico|bmp)(\?.*)?$') THEN 'image' WHEN regexp_matches(url, '(?i)\.(mp4|webm|mov|avi|mkv)(\?.*)?$|youtu\.?be|vimeo\.com|loom\.com|wistia\.com') THEN 'video' ELSE 'url' END AS link_type, near AS context,
    array_to_string({once(f"list_concat(own, {spelled('top')})")}[1:50], ' ') AS keywords FROM k"""


def document_link_labels(spark, d):
    return L.extract(table(spark, d, "documents").where("text is not null"), "doc_id", "text").select("doc_id", "url", "label")


def sentence_chunks(spark, d):
    return chunking.sentence_chunks(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


def overlapping_chunks(spark, d):
    return chunking.overlapping_chunks(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


#: Letters whose numbers stand in for an embedding, so that SQL can have the same.
LETTERS = "aeinorstаеиіноpст"


def letter_counts(texts: list[str]) -> list[list[float] | None]:
    found = [[float(t.count(c)) for c in LETTERS] for t in texts]
    return [v if any(v) else None for v in found]


def semantic_chunks(spark, d):
    found = chunking.semantic_chunks(table(spark, d, "documents").where("text is not null"), "doc_id", "text", letter_counts)
    return found.where(F.length("chunk") >= 80)


def parent_child_chunks(spark, d):
    return chunking.parent_child_chunks(table(spark, d, "documents").where("text is not null"), "doc_id", "file_id", "text")


def terminated_sentences(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(T.terminated_sentences(F.col("text"))).alias("pos", "sentence"))


QUERIES = {
    f.__name__: (f, sql)
    for f, sql in [
        (encoding_gate, ENCODING_SQL), (normalized_text, NORMALIZED_SQL), (stripped_markdown, STRIPPED_SQL), (word_counts, WORDS_SQL), (sentences, SENTENCES_SQL), (sections, SECTIONS_SQL), (file_ids, FILE_IDS_SQL), (sane_keywords, SANE_SQL),
        (header_keywords, HEADER_SQL), (url_keywords, _url_keywords_sql()), (frequency_keywords, FREQUENCY_SQL), (path_keywords, PATH_SQL), (question_keywords, QUESTION_SQL), (latin_spelling, LATIN_SQL), (name_variants, NAMES_SQL), (stems, _stem_sql()),
        (question_traits, TRAITS_SQL), (negation, NEGATION_SQL), (sanitized_answers, SANITIZED_SQL), (url_kinds, URL_SQL), (id_distance, DISTANCE_SQL), (question_kinds, _kinds_sql()), (expanded_questions, _expanded_sql()), (document_links, _document_links_sql()),
        (document_link_labels, LINKS_SQL), (sentence_chunks, chunk_sql.SENTENCE_CHUNKS), (overlapping_chunks, chunk_sql.OVERLAPPING_CHUNKS), (semantic_chunks, chunk_sql.semantic_chunks(LETTERS)), (parent_child_chunks, chunk_sql.PARENT_CHILD), (terminated_sentences, chunk_sql.TERMINATED),
    ]
}
