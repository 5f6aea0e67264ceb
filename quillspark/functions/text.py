"""Scalar and array text functions as column expressions; null in, null out, unless said otherwise."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.fixed import DOMAIN_STOP, ENDINGS, FREQUENCY_STOP, GRAPH_LATIN, QUERY_STOP, SINGLE_CYRILLIC, SINGLE_LATIN, TO_CYRILLIC, TO_LATIN

URL = r"https?://[^\s\"'<>]+"


def bad_character_share(text: Column) -> Column:
    """Share of replacement and control characters."""
    bad = F.length(text) - F.length(F.regexp_replace(text, "[�\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))
    return bad / F.greatest(F.length(text), F.lit(1))


def normalize_text(text: Column) -> Column:
    """Line ends to LF, runs of blanks to one, three and more line ends to two, trimmed."""
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"^\s+", ""), r"\s+$", "")


def strip_markdown(text: Column) -> Column:
    """Headings as [Title], without code, images, emphasis and table rules; links as their labels; table rows tidied."""
    steps = [
        (r"(?md)^#{1,6}[ \t]+([^\n]*[^\s])[ \t]*$", "\n[$1]"), (r"(?s)```.*?```", ""), (r"`([^`]+)`", "$1"), (r"!\[[^\n]*?\]\([^\n]*?\)", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\*\*|__|\*|_", ""), (r"(?md)^\|[-:| ]+\|$", ""), (r"(?md)^\|(\s*\|)+[ \t]*$", ""),
        (r"(?md)^\|[ \t]*([^\n]+?)[ \t]*\|$", "$1"), (r"(?m)[ \t]*\|[ \t]*", " | "),
    ]
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return normalize_text(text)


def words(text: Column) -> Column:
    """The runs of non-blank characters."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ?, cut before a capital letter; common abbreviations don't end a sentence."""
    guarded = F.regexp_replace(text, r"(?i)\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|e\.g|i\.e|Ph\.D|M\.D|B\.A|M\.A)\.", "$1\u0001")
    parts = F.split(guarded, r"(?<=[.!?])\s+(?=[A-ZА-ЯІЇЄҐ])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def terminated_sentences(text: Column) -> Column:
    """Parts that end in . ! ? or an ellipsis; Ukrainian abbreviations, initials and decimals don't end one. Nothing ended: the whole text."""
    out = F.regexp_replace(text, r"(?iU)\b(ст|рр|р|др|проф|доц|вул|пл|просп|обл|кв|год|грн|тис|млн|млрд|ім|пр|т|е|і|іст|буд|корп|оф|мал|табл|рис|п|п-т|с-щ)\.", "$1\u0001")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\b([А-ЯІЇЄҐA-Z])\.", "$1\u0001"), r"(\d)\.(\d)", "$1\u0001$2")
    found = F.regexp_extract_all(out, F.lit(r"[^.!?…]+[.!?…]+(?:\s|$)"), F.lit(0))
    parts = F.when(F.size(found) > 0, found).otherwise(F.array(out))
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def marked_sentences(text: Column) -> Column:
    """Parts that end in . ! or ?, with their blanks; nothing ended: the whole text."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]+"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def file_id(name: Column) -> Column:
    """A file name as an id of at most 50 letters, digits and underscores."""
    return F.left(F.lower(F.regexp_replace(F.regexp_replace(name, r"(?i)\.md$", ""), "[^a-zA-Z0-9]", "_")), F.lit(50))


def to_latin(text: Column, table: dict[str, str] = TO_LATIN) -> Column:
    """Cyrillic letters in Latin spelling, all in small letters."""
    out = F.lower(text)
    for a, b in table.items():
        if len(b) != 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    single = {a: b for a, b in table.items() if len(b) == 1}
    return F.translate(out, "".join(single), "".join(single.values()))


def to_cyrillic(text: Column) -> Column:
    """A best guess of the Cyrillic spelling; Latin letters without one are dropped."""
    out = F.lower(text)
    for a, b in TO_CYRILLIC:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(out, SINGLE_LATIN, SINGLE_CYRILLIC), "[a-z]", "")


def stem(word: Column) -> Column:
    """The word without its first fitting ending, if it has more than four letters and three are left."""
    w = F.lower(word)
    out = w
    for ending in reversed(ENDINGS):
        out = F.when(w.endswith(ending) & (F.length(w) - len(ending) >= 3), F.left(w, F.length(w) - len(ending))).otherwise(out)
    return F.when(F.length(w) > 4, out).otherwise(w)


def latin_majority(text: Column) -> Column:
    """More than half of the letters are Latin; false without letters."""
    latin = F.length(text) - F.length(F.regexp_replace(text, "[a-zA-Z]", ""))
    letters = F.length(text) - F.length(F.regexp_replace(text, "[a-zA-Zа-яіїєґёэъыА-ЯІЇЄҐ]", ""))
    return F.coalesce(F.try_divide(latin, letters) > 0.5, F.lit(False))


def negation(query: Column) -> Column:
    """A struct of the words asked for and of those after "not", Latin letters only."""
    tokens = F.filter(F.transform(F.split(F.lower(query), r"\s+"), lambda t: F.regexp_replace(t, "[^a-z]", "")), lambda t: t != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("include"), empty.alias("exclude"), F.lit(False).alias("negate"))

    def step(acc: Column, t: Column) -> Column:
        is_not = t == "not"
        return F.struct(
            F.when(is_not | acc["negate"], acc["include"]).otherwise(F.concat(acc["include"], F.array(t))).alias("include"),
            F.when(~is_not & acc["negate"], F.concat(acc["exclude"], F.array(t))).otherwise(acc["exclude"]).alias("exclude"),
            is_not.alias("negate"),
        )

    return F.aggregate(tokens, start, step, lambda acc: F.struct(acc["include"].alias("include"), acc["exclude"].alias("exclude")))


def sanitize_output(text: Column) -> Column:
    """Without blocks and tags of link markup; three and more line ends to two; trimmed."""
    out = F.regexp_replace(text, r"(?is)<(linksResult|linkResults|links_usage_rules)>.*?</\1>", "")
    out = F.regexp_replace(out, r"(?i)</?(linksResult|linkResults|links_usage_rules)>", "")
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"))


def holds_any(text: Column, patterns: list[str]) -> Column:
    """Whether any of the caller's patterns (attempts to override instructions, requests for links and the like) occurs, in any case; no patterns: false."""
    return F.lower(text).rlike("(?iu)" + "|".join(patterns)) if patterns else F.lit(False) & text.isNotNull()


def valid_url(url: Column) -> Column:
    """http or https with a dotted host; null and what can't be parsed are invalid."""
    return F.coalesce(url.rlike(r"^https?://") & F.try_parse_url(url, F.lit("HOST")).contains("."), F.lit(False))


def link_type(url: Column) -> Column:
    image = url.rlike(r"(?i)\.(png|jpe?g|gif|webp|svg|ico|bmp)(\?.*)?$")
    video = url.rlike(r"(?i)\.(mp4|webm|mov|avi|mkv)(\?.*)?$|youtu\.?be|vimeo\.com|loom\.com|wistia\.com")
    return F.when(image, "image").when(video, "video").otherwise("url")


def sane_keywords(keywords: Column) -> Column:
    """Those with a Latin or Cyrillic letter, without broken encodings, and not mostly of other characters."""

    def sane(kw: Column) -> Column:
        solid = F.length(F.regexp_replace(kw, r"\s", ""))
        broken = F.length(kw) - F.length(F.regexp_replace(kw, "[À-ÿ]", ""))
        other = F.length(F.regexp_replace(kw, r"[\wЀ-ӿ\s\-]", ""))
        fine = kw.rlike(r"[a-zA-ZЀ-ӿ]") & ~kw.contains("�") & ~kw.rlike(r"(?i)%[0-9a-f]{2}")
        return fine & (broken <= 0.3 * solid) & (other <= 0.4 * solid)

    return F.filter(keywords, sane)


def frequent_words(text: Column, most: int = 15, stop: list[str] | None = None) -> Column:
    """The most frequent words (of more than four characters) of a whole text as structs (n, word), earlier ones first at equal counts; none for null.

    Counted within the row in Arrow batches, so nothing is shuffled.
    """
    barred = frozenset(FREQUENCY_STOP if stop is None else stop)
    blank = re.compile(r"\s+", re.ASCII)

    @F.pandas_udf("array<struct<n:int,word:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            counts = Counter(blank.split(t)) if t else {}
            # words are in the order of their first occurrence, which the sort keeps
            kept = sorted(((w, n) for w, n in counts.items() if len(w) > 4 and w not in barred), key=lambda x: -x[1])
            return [{"n": n, "word": w} for w, n in kept[:most]]

        return texts.map(one)

    return run(F.lower(text))


def header_keywords(text: Column, most: int = 40) -> Column:
    """Words of the headings of the first three levels, also cut at inner capitals."""
    heads = F.regexp_extract_all(text, F.lit(r"(?md)^#{1,3}[ \t]+([^\n]+)$"), F.lit(1))
    parts = F.flatten(F.transform(heads, lambda h: F.split(F.regexp_replace(h, "[*_`~]", ""), r"[\s\-–—/|,;:()\[\]{}]+|(?=[A-Z])")))
    low = F.transform(parts, lambda w: F.lower(F.trim(w)))
    return F.slice(F.array_distinct(F.filter(low, lambda w: F.length(w) > 1)), 1, most)


def domain_parts(raw: Column) -> Column:
    """Parts of an address that can be keywords."""
    parts = F.transform(F.split(raw, r"[./\-_?&#=+:→\[\]()\\ |,\s]"), lambda s: F.lower(F.trim(s)))
    return F.filter(parts, lambda s: (F.length(s) > 1) & (F.length(s) < 30) & ~s.rlike(r"^\d+$") & ~s.rlike("(?i)%[0-9a-f]{2}") & ~s.rlike("^[a-z0-9]{20,}$") & ~s.isin(DOMAIN_STOP))


def url_keywords(text: Column, most: int = 50) -> Column:
    """Parts of the addresses in a text, those with a scheme first."""
    urls = F.regexp_extract_all(text, F.lit(r"https?://([^\s\"'<>]+)"), F.lit(1))
    rest = F.regexp_replace(text, URL, " ")
    bare = F.regexp_extract_all(rest, F.lit(r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.){1,5}[a-zA-Z]{2,10}\b"), F.lit(0))
    return F.slice(F.array_distinct(F.flatten(F.transform(F.concat(urls, bare), domain_parts))), 1, most)


def path_keywords(path: Column, most: int = 10) -> Column:
    parts = F.split(F.regexp_replace(path, r"(?i)\.md$", ""), r"[/\\\s_\-]+|(?=[A-Z])")
    return F.slice(F.array_distinct(F.filter(F.transform(parts, lambda w: F.lower(w)), lambda w: F.length(w) > 2)), 1, most)


def query_keywords(query: Column, most: int = 15) -> Column:
    """Words of a question of more than two characters that are no stop words."""
    parts = F.split(F.regexp_replace(F.lower(query), "[?!.,;:'\"]", " "), r"\s+")
    return F.slice(F.array_distinct(F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(QUERY_STOP))), 1, most)


def link_tokens(text: Column) -> Column:
    parts = F.split(F.lower(text), r"[\s\-_/|,;:()\[\]{}!?.'\"<>]+")
    return F.filter(parts, lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$"))


def noisy_entity(name: Column, kind: Column) -> Column:
    """Too short or long, a sentence, a user name, a bare number with a unit, or a concept with digits."""
    t = F.trim(name)
    return (F.length(t) < 2) | (F.length(t) > 60) | t.rlike("[!?]") | (~t.rlike(r"\s") & t.rlike("[._]")) | t.rlike(r"^\d+(\s+\S{1,6})?$") | ((kind == "concept") & t.rlike(r"\d"))


def entity_id(name: Column, kind: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(to_latin(name, TO_LATIN | GRAPH_LATIN), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.concat(slug, F.lit("_"), F.regexp_replace(F.lower(kind), "[^a-z0-9]", "_"))
