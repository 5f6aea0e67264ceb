"""Reading level of each document, comparable over languages (problem 10).

Only running text counts: code, links, headings, lists, tables and titles are cut away. Words, letters, sentences and
syllables are counted in one pass over Arrow batches. Syllables follow rules such as hyphenation uses: a nucleus is a Cyrillic vowel
or a group of Latin vowels; groups fall apart at the hiatus pairs of the language (HIATUS); English final e, -ed and -es are
mute, but for -le after a consonant, -ed after t and d and -es after a sibilant. Measures per word are set in proportion to
those of ordinary prose in the same language and script (ORDINARY, fixed constants, so a text has the same grade in any corpus);
then six classic formulas (Flesch-Kincaid, Fog, SMOG, Coleman-Liau, ARI, FORCAST) each estimate a grade.

grade is the median of the six at the text's own sentence length. word_grade is their median at a sentence length of SENTENCE words for all
texts: how demanding the wording is by itself. Bands are about wording (ordinary prose is standard whatever the
length of its sentences), so word_grade decides them. Their limits are fitted on a labelled sample of at most LABELS rows; without labels of
neighbouring bands the default limits hold.

Defined results: null, empty texts and texts without sentences have neither grade nor band.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.canon import INVISIBLE
from quillspark.llm.language import slices
from quillspark.llm.samples import below, smallest
from quillspark.llm.words import hash_of, hashes
from quillspark.session import cut

#: Zero-width and direction marks, soft hyphen.
ZERO_WIDTH = "\u00ad\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff"
#: Words of a sentence at which wordings are compared.
SENTENCE = 14.0
LABELS = 20_000
DEFAULT_LIMITS = (7.0, 16.0)
#: Syllables and letters per word, share of long words (three syllables in en and de, four in the others) and of words of one syllable in ordinary office prose, by
#: language and script; measured once as medians of documents, and constant since. The English ones are what the others are set in proportion to.
ORDINARY = {
    "en": (1.55, 5.03, 0.12, 0.59), "de": (2.26, 6.76, 0.34, 0.38), "pl": (2.44, 6.43, 0.16, 0.24), "uk-latin": (2.57, 6.58, 0.23, 0.23), "uk": (2.58, 6.14, 0.22, 0.23), "ru": (2.60, 6.13, 0.23, 0.23),
}
LATIN_VOWELS, CYRILLIC_VOWELS = "aeiouyäöüąęóéèêàáâíúýûôœæ", "аеёиоуыэюяіїє"
#: Pairs of Latin vowels that belong to two syllables.
HIATUS = {
    "en": ["ia", "io", "iu", "eo", "ua", "uo", "ao", "yi"], "de": ["ia", "io", "iu", "ea", "eo", "ua", "uo", "ao", "oa", "iä", "iö"],
    "pl": ["ea", "eo", "ao", "oa", "ae", "oe", "ui", "ue", "ua", "uo", "aa", "oo", "ee", "yo", "ya"], "uk-latin": ["oi", "ai", "ui", "ao", "oa", "ea", "eo", "ae", "uo", "ua"],
}
#: English endings whose io is one syllable after all.
ONE_NUCLEUS = ("t", "s", "c", "x")
SPELLINGS = ["en", "de", "pl", "uk-latin", "uk", "ru"]
#: Frequent function words, by which language and script are told.
FUNCTION_WORDS = {
    "en": ["the", "is", "a", "and", "to", "of", "in", "you", "at", "that", "it"], "de": ["der", "die", "das", "den", "und", "ist", "im", "in", "du", "nicht", "wir", "hier", "des", "zu", "ein", "für", "von"],
    "pl": ["jest", "się", "nie", "na", "do", "to", "w", "i", "z", "o", "oraz", "mają", "są", "przez", "po", "że"],
    "uk-latin": ["i", "na", "u", "do", "z", "ta", "tse", "my", "ne", "ia", "pro", "shcho", "pid", "abo", "dlia", "mozhut", "za", "iz"],
    "uk": ["і", "на", "у", "до", "з", "та", "це", "ми", "не", "я", "про", "що", "під", "або", "для", "можуть", "мають", "за", "із", "є", "як", "й"],
    "ru": ["и", "на", "в", "до", "с", "это", "мы", "не", "я", "про", "что", "под", "или", "для", "могут", "должны", "за", "из", "есть", "как", "о", "к"],
}
#: What is no running text: code, tags, links and addresses; lines of tables, headings and lists; lines without an end mark.
NOT_RUNNING = [
    r"(?s)```.*?(?:```|\z)|`[^`\n]*`|<\|[^|\n]*\|>|\[[^\]\n]*\]\([^)\n]*\)|<?https?://\S+>?",
    r"(?m)^[ \t]*(?:\||#+[ \t]|(?:[-*•]|\d+[.)])[ \t])[^\n]*$",
    r"(?m)^(?![^\n]*[.!?…;:][\"”»)]*[ \t\r]*$)[ \t]*(?:\S+[ \t]+){0,7}\S+[ \t\r]*$",
]


def running_text(text: Column) -> Column:
    """The sentences of a text, in small letters; full-width characters are plain, invisible ones gone."""
    out = text
    for pattern in NOT_RUNNING:
        out = F.regexp_replace(out, pattern, "\n")
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    # translate drops what has no counterpart
    return F.lower(F.translate(F.trim(out), wide + INVISIBLE + ZERO_WIDTH, plain))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point of the first plane: 0 nothing, 1 other letter, 2 Latin vowel, 3 Cyrillic vowel, 4 end mark, 5 closing mark, 6 white space."""
    out = np.zeros(65536, np.int8)
    for code in range(65536):
        c = chr(code)
        out[code] = 2 if c in LATIN_VOWELS else 3 if c in CYRILLIC_VOWELS else 1 if c.isalpha() else 4 if c in ".!?…" else 5 if c in "\"”»)" else 6 if c.isspace() else 0
    return out


@lru_cache(maxsize=1)
def _hiatus() -> np.ndarray:
    """Pairs of letters (below 0x180) by language that are two nuclei."""
    out = np.zeros((len(SPELLINGS), 0x180, 0x180), bool)
    for name, pairs in HIATUS.items():
        for a, b in pairs:
            out[SPELLINGS.index(name), ord(a), ord(b)] = True
    return out


@lru_cache(maxsize=1)
def function_words() -> list[np.ndarray]:
    return [np.array([hash_of(w) for w in FUNCTION_WORDS[name]], np.uint64) for name in SPELLINGS]


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """spelling (place in SPELLINGS), words, sentences, letters, syllables, hard, ones of each text, given in small letters."""
    n = len(texts)
    lengths = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    codes = np.minimum(np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "replace"), np.uint32), 65535)
    row = np.repeat(np.arange(n), lengths)
    kind = _kinds()[codes]
    per_row = lambda where, w=None: np.bincount(where, weights=w, minlength=n).astype(float)
    # a sentence ends where white space follows closing marks (or none) that follow an end mark
    space = kind == 6
    place = np.arange(len(codes))
    solid = np.maximum.accumulate(np.where(kind != 5, place, 0))
    stops = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    sentences = per_row(row[stops[kind[solid[stops - 1]] == 4]])
    letter = (kind >= 1) & (kind <= 3)
    at = np.flatnonzero(letter)
    begins = letter & np.r_[True, ~letter[:-1]]
    first = np.flatnonzero(begins)
    m = len(first)
    word = (np.cumsum(begins) - 1)[at]
    size = np.bincount(word, minlength=m)
    of_row = row[first]
    # language and script
    h = hashes(codes[at], at - first[word], np.cumsum(size) - size)
    said = np.stack([per_row(of_row[np.isin(h, words)]) for words in function_words()], axis=1)
    cyrillic, latin = kind == 3, kind == 2
    previous = np.r_[False, latin[:-1]]
    groups = latin & ~previous
    mostly = per_row(row[cyrillic]) > per_row(row[groups])
    spelling = np.where(mostly, 4 + said[:, 4:].argmax(axis=1), said[:, :4].argmax(axis=1))
    # nuclei: Cyrillic vowels, groups of Latin ones, and pairs of two syllables within a group
    inner = np.flatnonzero(latin & previous)
    a, b = np.minimum(codes[inner - 1], 0x17F), np.minimum(codes[inner], 0x17F)
    apart = _hiatus()[spelling[row[inner]], a, b]
    before = codes[np.maximum(inner - 2, 0)]
    apart &= ~((spelling[row[inner]] == 0) & (a == ord("i")) & (b == ord("o")) & np.isin(before, [ord(c) for c in ONE_NUCLEUS]))
    nucleus = cyrillic | groups
    nucleus[inner[apart]] = True
    nuclei = np.bincount(word, weights=nucleus[at], minlength=m) if m else np.zeros(0)
    # mute endings of English
    if m:
        end = first + size - 1
        z, y, x = codes[end], codes[np.maximum(end - 1, 0)], codes[np.maximum(end - 2, 0)]
        among = lambda c, letters: np.isin(c, [ord(l) for l in letters])
        vowel = lambda i: kind[np.maximum(i, 0)] == 2
        e = (z == ord("e")) & ~vowel(end - 1) & ~((y == ord("l")) & ~vowel(end - 2))
        ed = (z == ord("d")) & (y == ord("e")) & ~among(x, "td") & ~vowel(end - 2)
        es = (z == ord("s")) & (y == ord("e")) & ~among(x, "szxcgh") & ~vowel(end - 2)
        nuclei -= (spelling[of_row] == 0) & (size > 2) & (nuclei > 1) & (e | ed | es)
    syllables = np.maximum(1, nuclei)
    long = np.where(spelling[of_row] < 2, 3, 4)
    return {
        "spelling": spelling, "words": per_row(of_row), "sentences": sentences, "letters": per_row(row[at]), "syllables": per_row(of_row, syllables),
        "hard": per_row(of_row[syllables >= long]), "ones": per_row(of_row[syllables == 1]),
    }


def counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, spelling and the counts that the formulas need, of each text with words and sentences; in one pass, written once."""
    kind = docs.schema[key].dataType
    names = ["words", "sentences", "letters", "syllables", "hard", "ones"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = measure(batch.column(1).to_pylist())
            some = np.flatnonzero((found["words"] > 0) & (found["sentences"] > 0))
            spelling = pa.array(np.array(SPELLINGS, dtype=object)[found["spelling"][some]], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)).cast(to_arrow_type(kind)), spelling, *(pa.array(found[c][some]) for c in names)], names=[key, "spelling", *names])

    rows = docs.select(F.col(key), running_text(F.col(text)).alias("t")).where("t <> ''")
    return cut(rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, spelling string, " + ", ".join(f"{c} double" for c in names)))


def _median_grade(asl: Column, asw: Column, cpw: Column, phw: Column, ones: Column) -> Column:
    estimates = F.array_sort(F.array(
        0.39 * asl + 11.8 * asw - 15.59, 0.4 * (asl + 100 * phw), 1.043 * F.sqrt(F.greatest(F.lit(0.0), phw * asl * 30)) + 3.13,
        5.88 * cpw - 29.6 / asl - 15.8, 4.71 * cpw + 0.5 * asl - 21.43, 20 - 15 * ones,
    ))
    return (F.element_at(estimates, 3) + F.element_at(estimates, 4)) / 2


def grades(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, spelling, words, sentences, grade, word_grade of each document with running text."""
    rows = counts(docs, key, text)
    table = F.create_map(*(x for name, values in ORDINARY.items() for x in (F.lit(name), F.array(*map(F.lit, values)))))
    rows = rows.withColumn("__o", table[F.col("spelling")])
    own = lambda c, i: F.col(c) / F.col("words") / F.col("__o")[i]
    en = ORDINARY["en"]
    asw, cpw = own("syllables", 0) * en[0], own("letters", 1) * en[1]
    phw, ones = F.col("hard") / F.col("words") - F.col("__o")[2] + en[2], F.col("ones") / F.col("words") - F.col("__o")[3] + en[3]
    asl = F.col("words") / F.col("sentences")
    return rows.select(key, "spelling", "words", "sentences", _median_grade(asl, asw, cpw, phw, ones).alias("grade"), _median_grade(F.lit(SENTENCE), asw, cpw, phw, ones).alias("word_grade"))


def fit_limits(grade: list[float], band: list[str]) -> tuple[float, float]:
    """The limits between easy and standard and between standard and hard with the fewest errors, in the middle of the gap."""
    g, b = np.array(grade), np.array(band)
    out = []
    for low, high, default in (("easy", "standard", DEFAULT_LIMITS[0]), ("standard", "hard", DEFAULT_LIMITS[1])):
        x, above = g[(b == low) | (b == high)], (b == high)[(b == low) | (b == high)]
        if above.all() or not above.any():
            out.append(default)
            continue
        order = np.argsort(x)
        x, above = x[order], above[order]
        errors = np.r_[0, np.cumsum(above)] + np.r_[np.cumsum((~above)[::-1])[::-1], 0]
        best = np.flatnonzero(errors == errors.min())
        mid = best[len(best) // 2]
        out.append(float(x[0] - 1 if mid == 0 else x[-1] + 1 if mid == len(x) else (x[mid - 1] + x[mid]) / 2))
    return out[0], max(out)


def levels(docs: DataFrame, key: str, text: str, labels: DataFrame) -> DataFrame:
    """grades with the band (easy, standard, hard) of each document; labels: key, band, of several annotators."""
    graded = grades(docs, key, text)
    # the majority of the annotators; ties have no say
    votes = labels.where(F.col("band").isNotNull()).groupBy(key, "band").count()
    best = votes.groupBy(key).agg(F.max("count").alias("m"), F.max_by("band", "count").alias("band"), F.collect_list("count").alias("all"))
    sure = best.where(F.size(F.filter("all", lambda c: c == F.col("m"))) == 1).select(key, "band")
    # those of smallest hash, some LABELS at most
    some = sure.where(below(F.xxhash64(key), smallest(sure.count(), LABELS)))
    known = graded.join(some, key).select("word_grade", "band").collect()
    easy, hard = fit_limits([r["word_grade"] for r in known], [r["band"] for r in known])
    band = F.when(F.col("word_grade") < easy, "easy").when(F.col("word_grade") >= hard, "hard").otherwise("standard")
    return graded.withColumn("band", band)
