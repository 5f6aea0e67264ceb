"""SQL counterparts, by recursive queries, of the chunkers and of what is built on them."""

from __future__ import annotations

#: White space of any kind, as a class of characters.
BLANK = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|e\\.g|i\\.e|Ph\\.D|M\\.D|B\\.A|M\\.A"
UKRAINIAN = "ст|рр|р|др|проф|доц|вул|пл|просп|обл|кв|год|грн|тис|млн|млрд|ім|пр|т|е|і|іст|буд|корп|оф|мал|табл|рис|п|п-т|с-щ"


def bare(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{BLANK}]+', ''), '[{BLANK}]+$', '')"


def sentences(x: str) -> str:
    """The list of sentences before capital letters."""
    guarded = f"regexp_replace({x}, '(?i)\\b({ABBREVIATIONS})\\.', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split(regexp_replace({guarded}, '([.!?])\\s+([A-ZА-ЯІЇЄҐ])', '\\1' || chr(3) || '\\2', 'g'), chr(3)), lambda s: trim(replace(s, chr(1), '.'), ' ')), lambda s: s <> '')"


def terminated(x: str) -> str:
    """The list of sentences that end in a mark."""
    once = lambda t: f"regexp_replace({t}, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])({UKRAINIAN})\\.', '\\1\\2' || chr(1), 'g')"
    out = once(once(x))
    initial = lambda t: f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])([А-ЯІЇЄҐA-Z])\\.', '\\1\\2' || chr(1), 'g')"
    out = f"regexp_replace({initial(initial(out))}, '(\\d)\\.(\\d)', '\\1' || chr(1) || '\\2', 'g')"
    return f"(SELECT list_filter(list_transform(CASE WHEN len(f) > 0 THEN f ELSE [o] END, lambda s: trim(replace(s, chr(1), '.'), ' ')), lambda s: s <> '') FROM (SELECT o, regexp_extract_all(o, '[^.!?…]+[.!?…]+(?:\\s|$)') AS f FROM (SELECT {out} AS o)))"


PARAGRAPHS = "list_filter(list_transform(regexp_split_to_array(text, '\\n\\n+'), lambda p: trim(p, ' ')), lambda p: p <> '')"
TERMINATED = f"WITH t AS (SELECT doc_id, {terminated('text')} AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM t"
COUNT = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"

SENTENCE_CHUNKS = f"""WITH RECURSIVE t AS (SELECT doc_id, flatten(list_transform({PARAGRAPHS}, lambda p: {sentences('p')})) AS l FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM t), n AS (SELECT *, {COUNT.format('s')} AS n FROM s),
  r AS (SELECT doc_id, i, s AS now, n, 0 AS pos, NULL::VARCHAR AS done FROM n WHERE i = 1
    UNION ALL SELECT r.doc_id, x.i, CASE WHEN r.n + x.n > 150 AND r.n >= 20 THEN x.s ELSE r.now || ' ' || x.s END, CASE WHEN r.n + x.n > 150 AND r.n >= 20 THEN x.n ELSE r.n + x.n END,
      CASE WHEN r.n + x.n > 150 AND r.n >= 20 THEN pos + 1 ELSE pos END, CASE WHEN r.n + x.n > 150 AND r.n >= 20 THEN r.now END FROM r JOIN n x ON x.doc_id = r.doc_id AND x.i = r.i + 1),
  c AS (SELECT doc_id, pos - 1 AS pos, done AS chunk FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, pos, now FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)
  SELECT doc_id, pos, chunk FROM c WHERE length(trim(chunk, ' ')) >= 80"""

#: now is what is joined so far (null for nothing), n its words, place the end of the sentences so far; a blank item ends a paragraph.
OVERLAPPING_CHUNKS = f"""WITH RECURSIVE t AS (SELECT doc_id, flatten(list_transform({PARAGRAPHS}, lambda p: list_append({sentences('p')}, chr(2)))) AS l FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM t), m AS (SELECT *, CASE WHEN s = chr(2) THEN 0 ELSE {COUNT.format('s')} END AS n FROM s),
  r AS (SELECT doc_id, 0::BIGINT AS i, NULL::VARCHAR AS now, 0::BIGINT AS n, 0::BIGINT AS place, 0 AS pos, NULL::VARCHAR AS done, 0::BIGINT AS stop FROM t
    UNION ALL SELECT doc_id, i, CASE WHEN s = chr(2) THEN CASE WHEN now IS NULL THEN NULL ELSE now || ' ' END WHEN closes THEN array_to_string(tail, ' ') || ' ' || s WHEN now IS NULL THEN s ELSE now || ' ' || s END,
      CASE WHEN s = chr(2) THEN n WHEN closes THEN len(tail) + m ELSE n + m END, CASE WHEN s = chr(2) THEN place ELSE place + length(s) + 1 END, CASE WHEN closes THEN pos + 1 ELSE pos END, CASE WHEN closes THEN now END, place
      FROM (SELECT r.doc_id, x.i, x.s, r.now, r.n, r.place, r.pos, x.n AS m, x.s <> chr(2) AND r.n + x.n > 200 AND r.n >= 50 AS closes, regexp_split_to_array(r.now, '\\s+')[-20:] AS tail FROM r JOIN m x ON x.doc_id = r.doc_id AND x.i = r.i + 1)),
  c AS (SELECT doc_id, pos - 1 AS pos, done AS chunk, stop FROM r WHERE done IS NOT NULL
    UNION ALL SELECT doc_id, pos, {bare('now')}, place FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) WHERE {bare("coalesce(now, '')")} <> '')
  SELECT doc_id, pos, chunk, stop - length(chunk) AS start_index, stop AS end_index FROM c"""


def semantic_chunks(letters: str) -> str:
    """Runs by a stand-in of an embedding: how often each of some letters occurs in a sentence; nothing for a sentence without them."""
    vector = "[" + ", ".join(f"(length(s) - length(replace(s, '{c}', '')))::DOUBLE" for c in letters) + "]"
    mixed = "list_transform(list_zip(centre, v), lambda z: (z[1] * (length(now) + 1 + length(s)) + z[2] * length(s)) / (length(now) + 1 + 2 * length(s)))"
    return f"""WITH RECURSIVE t AS (SELECT doc_id, {terminated('text')} AS l FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM t),
  e AS (SELECT doc_id, i, s, CASE WHEN list_sum(v) > 0 THEN v END AS v FROM (SELECT *, {vector} AS v FROM s)),
  r AS (SELECT doc_id, -1::BIGINT AS i, '' AS now, NULL::DOUBLE[] AS centre, 0::BIGINT AS first, NULL::VARCHAR AS done, 0::BIGINT AS begin, 0::BIGINT AS nth FROM t
    UNION ALL SELECT doc_id, i, CASE WHEN v IS NULL THEN '' WHEN fresh THEN s ELSE now || ' ' || s END, CASE WHEN fresh THEN v ELSE {mixed} END, CASE WHEN v IS NULL THEN i + 1 WHEN fresh THEN i ELSE first END, CASE WHEN emits THEN now END, first, nth + emits::INT
      FROM (SELECT *, v IS NULL OR centre IS NULL OR emits AS fresh FROM (SELECT *, (v IS NULL OR (centre IS NOT NULL AND (list_cosine_similarity(centre, v) < 0.7 OR length(now) > 500))) AND length(now) >= 100 AS emits
        FROM (SELECT r.doc_id, e.i, e.s, e.v, r.now, r.centre, r.first, r.nth FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1)))),
  c AS (SELECT doc_id, nth - 1 AS pos, {bare('done')} AS chunk, begin AS first, i - 1 AS last FROM r WHERE done IS NOT NULL
    UNION ALL SELECT doc_id, nth, {bare('now')}, first, i FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) WHERE {bare('now')} <> '')
  SELECT doc_id, pos, chunk, first, last FROM c WHERE length(chunk) >= 80"""


def _cut(text: str, want: str, window: str) -> str:
    """Where a text is best cut for a size wanted: see chunking.CutPlaces."""
    low = f"greatest(0, {want} - {window})"
    part = f"substr({text}, {low} + 1, {want} - {low})"
    solid = f"regexp_replace({part}, '[{BLANK[2:]} \\t\\r\\f]*$', '')"
    gap = f"regexp_replace({part}, '[^{BLANK}]*$', '')"
    return f"""CASE WHEN {want} >= length({text}) THEN length({text}) WHEN regexp_matches({solid}, '[.!?…\\n]$') AND {low} + length({solid}) > 0.85 * {want} THEN {low} + length({solid})
      WHEN {gap} <> '' THEN {low} + length({gap}) ELSE {want} END"""


def families(parent: int = 4000, child: int = 1200, overlap: int = 150, file_id: str = "coalesce(nullif(file_id, ''), 'doc')", source: str = "(SELECT doc_id, file_id, text FROM documents WHERE text <> '')") -> str:
    """Common table expressions that end in f: doc_id, chunk_id, parent_id, level, start_index, end_index, section_title, text."""
    return f"""d AS (SELECT doc_id, {file_id} AS file, string_split(regexp_replace(text, '(?m)^(#{{1,2}}[ \\t]+\\S)', chr(1) || '\\1', 'g'), chr(1)) AS l FROM {source}),
  q AS (SELECT doc_id, file, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM d), b AS (SELECT doc_id, file, k, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) - length(p) AS low, {bare('p')} AS body, CASE WHEN regexp_matches(p, '^#{{1,2}}[ \\t]+\\S') THEN {bare(f"string_split({bare('p')}, chr(10))[1]")} END AS title FROM q),
  w AS (SELECT doc_id, file, k, low, title, body, 0::BIGINT AS lo, least(length(body), greatest(1, {_cut('body', f'least({parent}, length(body))', '200')}))::BIGINT AS stop FROM b WHERE body <> ''
    UNION ALL SELECT doc_id, file, k, low, title, body, stop, CASE WHEN stop + {parent} >= length(body) THEN length(body) ELSE greatest(stop + 1, {_cut('body', f'(stop + {parent})', '200')}) END::BIGINT FROM w WHERE stop < length(body)),
  g AS (SELECT *, {bare('substr(body, lo + 1, stop - lo)')} AS piece FROM w), pa AS (SELECT doc_id, file || '_p' || (row_number() OVER (PARTITION BY doc_id ORDER BY k, lo) - 1) AS id, low + lo AS begin, CASE WHEN lo = 0 THEN title END AS title, piece FROM g WHERE piece <> ''),
  ch AS (SELECT doc_id, id, begin, title, piece, 0::BIGINT AS lo, CASE WHEN {child} >= length(piece) THEN length(piece) ELSE greatest(1, {_cut('piece', str(child), '200')}) END::BIGINT AS stop FROM pa
    UNION ALL SELECT doc_id, id, begin, title, piece, again, CASE WHEN again + {child} >= length(piece) THEN length(piece) ELSE greatest(again + 1, {_cut('piece', f'(again + {child})', '200')}) END::BIGINT
      FROM (SELECT *, CASE WHEN back > lo THEN back ELSE stop END AS again FROM (SELECT *, {_cut('piece', f'greatest(0, stop - {overlap})', str(overlap))} AS back FROM ch WHERE stop < length(piece)))),
  ck AS (SELECT doc_id, id, begin + lo AS low, begin + stop AS high, title, lo, {bare('substr(piece, lo + 1, stop - lo)')} AS piece FROM ch),
  f AS (SELECT doc_id, id AS chunk_id, NULL::VARCHAR AS parent_id, 0 AS level, begin AS start_index, begin + length(piece) AS end_index, title AS section_title, piece AS text FROM pa
    UNION ALL SELECT doc_id, id || '_c' || (row_number() OVER (PARTITION BY doc_id, id ORDER BY lo) - 1), id, 1, low, high, title, piece FROM ck WHERE piece <> '')"""


PARENT_CHILD = f"WITH RECURSIVE {families()} SELECT doc_id, chunk_id, parent_id, level, start_index, end_index, section_title, text FROM f"
