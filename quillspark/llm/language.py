"""Language of each text and of its stretches, whatever its label says (problem 3).

A bit-sliced Bloom filter holds the character n-grams of all languages: each slot is a byte with one
bit per language, and the AND of an n-gram's slots gives all languages that contain it. A text is
cut into units (sentences, lines); the bits of a unit's n-grams are counted per language, the
counts corrected by each language's false-positive rate, and the largest decides. The confidence
(0 to 1) is the margin of the largest over the second in proportion to it, times the share of n-grams known.

The filter is fitted on a bounded sample of labelled rows (at most SAMPLE_ROWS of each table, besides LANGUAGE_ROWS of each language); labels may be
wrong: an n-gram belongs to a language only if its frequency there is a fair share of its frequencies
in all, and the sample is labelled anew by the first fit for a second one. Ukrainian sentences
are also added in Latin spelling.

Before, text is brought to one form: invisible characters go, full-width and look-alike letters get
one prototype, case is folded. Code, links and addresses are no text.

Defined results: null, empty texts and those without words of a known language get a null language
and confidence 0. Texts of any length are processed whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.fixed import TO_LATIN
from quillspark.llm.canon import INVISIBLE, letter_map
from quillspark.llm.samples import below, smallest

#: Languages by default; a filter holds up to eight.
LANGS = ["en", "uk", "ru", "pl", "de"]
#: Forms of labels.
LABELS = {
    "en": ["en", "eng", "english"], "uk": ["uk", "ukr", "ua", "ukrainian"], "ru": ["ru", "rus", "russian"],
    "pl": ["pl", "pol", "polish"], "de": ["de", "deu", "ger", "german"],
}
SAMPLE_ROWS = 1500
#: Rows of each language that are in the sample at least, as far as there are any.
LANGUAGE_ROWS = 300
#: Sampled texts whose n-grams are held at once while fitting.
FIT_BATCH = 200
SIZES = (3, 4, 5)
SLOT_BITS = 20
#: Letters whose n-grams are held at once, and characters of the texts that are.
BLOCK, CHARS = 2**18, 2_000_000
#: Least share of all n-grams for a spelling (a language in one script) to count; least share of an n-gram's relative frequencies, and least count, for its bit to be set; more at the first fit, whose labels may be wrong.
RARE = 0.02
TELLING = 0.75
FIRST_SHARE, SHARE, COUNT = 0.35, 0.22, 3
#: Code, links, addresses, tags and references, which are no text.
NOISE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\[[^\]\n]*\]\([^)\n]*\)|<[^<>\n]+>|https?://\S+|www\.\S+|\S+@\S+|\b[A-Z]{2,5}-\d+\b", re.S)
#: Quotations and asides, whose language doesn't count for the sentence around them.
ASIDE = re.compile(r"«[^«»\n]+»|“[^“”\n]+[”“]|„[^„“”\n]+[“”]|\"[^\"\n]+\"|\([^()\n]+\)|\[[^\[\]\n]+\]")
#: Ends of sentences and lines.
ENDS = re.compile(r"[.!?…。．！？][.!?…]*[\"'”»)\]*_]*(?=\s|\Z)|\r?\n")


def label_language(label: Column, labels: dict[str, list[str]] = LABELS) -> Column:
    """The language that a label names, in any of its common forms; null if it names none of them."""
    first = F.element_at(F.split(F.lower(F.trim(label)), r"[-_ ]"), 1)
    out = F.lit(None).cast("string")
    for code, forms in labels.items():
        out = F.when(first.isin(forms), code).otherwise(out)
    return out


@lru_cache(maxsize=1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane: 0 (gone), 32 (no letter) or the letter in its one form; whether it is a capital."""
    table = np.full(65536, 32, np.uint32)
    prototypes = letter_map()
    small = {}
    for a, b in prototypes.items():
        if a.lower() == a and len(b) == 1:
            small[a] = b
    for code in range(65536):
        c = chr(code)
        low = prototypes.get(c, c) if 0xFF00 <= code else c
        low = low.lower()
        if len(low) == 1 and low.isalpha():
            table[code] = ord(small.get(low, low))
    for c in INVISIBLE:
        table[ord(c)] = 0
    for code in [0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0x300, 0x370)]:
        table[code] = 0
    return table, np.array([chr(c).isupper() for c in range(65536)])


def folded_letters() -> np.ndarray:
    """For each code point of the first plane: 0 (gone), 32 (no letter) or the letter in its one form."""
    return _fold()[0]


class Units:
    """Sentences and lines of a batch of texts, and the hashed n-grams of each."""

    def __init__(self, texts: list[str | None], keep_names: bool = False):
        self.row, self.start, self.end, self.full, self.last = [], [], [], [], []
        parts, units, raw = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            clean = text
            if "`" in text or "/" in text or "<" in text or "@" in text or "-" in text:
                clean = NOISE.sub(lambda m: " " * len(m[0]), text)
            plain = ASIDE.sub(lambda m: " " * len(m[0]), clean) if any(c in clean for c in '«“„"([') else clean
            if not plain.strip() or not any(map(str.isalpha, plain)):  # nothing but asides: these count then, save bare titles in brackets
                plain = clean if not text.strip().startswith("[") else plain
            at = 0
            for m in [*ENDS.finditer(plain), None]:
                stop = m.end() if m else len(plain)
                if stop > at:
                    self.row.append(i)
                    self.start.append(at)
                    self.end.append(stop)
                    self.full.append(self._full(plain, at, stop, m))
                    self.last.append(stop == len(plain))
                    units.append(stop - at)
                at = stop
            parts.append(plain)
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
        unit = np.repeat(np.arange(len(units)), units)
        table, upper = _fold()
        codes = np.minimum(codes, 65535)
        folded = table[codes] if keep_names else self._without_names(table[codes], upper[codes], unit, len(units))
        keep = folded != 0
        folded, unit = folded[keep], unit[keep]
        # runs of non-letters become one space, each unit begins and ends with one
        space = folded == 32
        first = np.r_[True, unit[1:] != unit[:-1]] if len(unit) else np.zeros(0, bool)
        keep = ~space | (np.r_[True, ~space[:-1]] | first if len(unit) else space)
        self.codes, self.unit = folded[keep], unit[keep]
        self.n = len(units)
        starts = (self.codes != 32) & (np.r_[True, (self.codes[:-1] == 32) | (self.unit[1:] != self.unit[:-1])] if len(self.codes) else np.zeros(0, bool))
        self.words = np.bincount(self.unit[starts], minlength=self.n)
        self.word, self.unit_of_word = np.cumsum(starts) - 1, self.unit[starts]
        self.row = np.array(self.row, np.int64)
        self.full = np.array(self.full, bool)
        self.last = np.array(self.last, bool)

    @staticmethod
    def _without_names(folded: np.ndarray, upper: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
        """Capitalised words inside a unit made blank, if two other words are left: most are names, which belong to no language."""
        if not len(folded):
            return folded
        letter = folded != 32
        edge = unit[1:] != unit[:-1]
        start = letter & np.r_[True, ~letter[:-1] | edge]
        word = np.cumsum(start) - 1
        begin = np.flatnonzero(start)
        if not len(begin):
            return folded
        own = unit[begin]
        first = np.r_[True, own[1:] != own[:-1]]
        second = np.minimum(begin + 1, len(folded) - 1)
        title = upper[begin] & ~first & (folded[second] != 32) & ~upper[second]
        title &= (np.bincount(own[~title], minlength=n) >= 2)[own]
        return np.where(letter & title[np.maximum(word, 0)] & (word >= 0), 32, folded).astype(folded.dtype)

    @staticmethod
    def _full(text: str, at: int, stop: int, m: re.Match | None) -> bool:
        """A sentence by its form: it ends as one. Headings, list items, quoted lines and table rows aren't, if they don't."""
        head = text[at:stop].lstrip()[:1]
        if head in (">", "|"):
            return False
        return bool(m and m[0].strip())

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word and hash of each n-gram that lies in one word with at most its two edges, for BLOCK letters at a time."""
        c, u = self.codes.astype(np.uint64), self.unit
        space = self.codes == 32
        for low in range(0, len(c), BLOCK):
            units, hashes = [], []
            for n in SIZES:
                high = min(low + BLOCK, len(c) - n + 1)
                if high <= low:
                    continue
                ok = u[low:high] == u[low + n - 1 : high + n - 1]
                for j in range(1, n - 1):
                    ok &= ~space[low + j : high + j]
                at = low + np.flatnonzero(ok)
                h = np.full(len(at), n, np.uint64)
                for j in range(n):
                    h = h * np.uint64(0x100000001B3) + c[at + j]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                units.append(self.word[at + 1])  # the first letter may be the blank before
                hashes.append(h ^ (h >> np.uint64(32)))
            if units:
                yield np.concatenate(units), np.concatenate(hashes)


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about CHARS characters (a longer text is a part by itself), which bounds the memory of a task."""
    sizes = np.array([len(t) if t else 0 for t in batch.column(text).to_pylist()], np.int64)
    part = np.cumsum(sizes) // CHARS
    edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if high > low:
            yield batch.slice(low, high - low)


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(2**SLOT_BITS - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(SLOT_BITS)) & mask).astype(np.int64)


class Filter:
    """Bit-sliced Bloom filter of two probes, and the false-positive rate of each language."""

    def __init__(self, grams: np.ndarray, members: np.ndarray, langs: list[str]):
        if len(langs) > 8:
            raise ValueError("a slot has a bit for eight languages at most")
        self.langs = list(langs)
        self.bits = np.zeros(2**SLOT_BITS, np.uint8)
        for l in range(len(langs)):
            for slot in _slots(grams[(members >> l) & 1 == 1]):
                np.bitwise_or.at(self.bits, slot, np.uint8(1 << l))
        fill = np.array([((self.bits >> l) & 1).mean() for l in range(len(langs))])
        self.false = fill**2

    def counts(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits of each unit and language, and the n-grams of each unit. Only words that a language knows for the most part count for it."""
        m, many = len(units.unit_of_word), len(self.langs)
        hits, total = np.zeros((m, many)), np.zeros(m)
        for word, h in units.blocks():
            a, b = _slots(h)
            found = self.bits[a] & self.bits[b]
            low, high = int(word.min(initial=m)), int(word.max(initial=-1)) + 1
            if high <= low:
                continue
            total[low:high] += np.bincount(word - low, minlength=high - low)
            found[found == (1 << many) - 1] = 0  # what is in the filters of all languages tells nothing
            for l in range(many):
                hits[low:high, l] += np.bincount(word[(found >> l) & 1 == 1] - low, minlength=high - low)
        hits = np.maximum(0, (hits - self.false * total[:, None]) / (1 - self.false))
        hits[hits < MOSTLY * total[:, None]] = 0
        own = np.stack([np.bincount(units.unit_of_word, weights=hits[:, l], minlength=units.n) for l in range(many)], axis=1)
        return own, np.bincount(units.unit_of_word, weights=total, minlength=units.n)


class _Counts:
    """Numbers of each n-gram by spelling: a language in other scripts or in Latin script, else the one thins out the other."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.grams, self.count = np.zeros(0, np.uint64), np.zeros((0, 2 * len(langs)), np.int64)

    def add(self, units: Units, unit: np.ndarray, h: np.ndarray, lang: np.ndarray) -> None:
        """lang: of each unit, -1 for none."""
        letters = np.bincount(units.unit[units.codes > 32], minlength=units.n)
        latin = np.bincount(units.unit[(units.codes > 32) & (units.codes < 0x250)], minlength=units.n) > 0.7 * letters
        own = np.where(lang >= 0, lang + len(self.langs) * latin, -1)[unit]
        grams, place = np.unique(np.concatenate([self.grams, h[own >= 0]]), return_inverse=True)
        count = np.zeros((len(grams), 2 * len(self.langs)), np.int64)
        count[place[: len(self.grams)]] = self.count
        np.add.at(count, (place[len(self.grams) :], own[own >= 0]), 1)
        self.grams, self.count = grams, count

    def filter(self, least: float) -> Filter:
        count = self.count
        rate = count / np.maximum(1, count.sum(axis=0))
        rate[:, count.sum(axis=0) < RARE * max(1, count.sum())] = 0  # a spelling as rare as wrong labels are
        share = rate / np.maximum(1e-12, rate.sum(axis=1, keepdims=True))
        top = np.sort(share, axis=1)
        telling = top[:, -1] + top[:, -2] >= TELLING  # names and the like occur in all
        member = (share >= least) & (count >= COUNT) & telling[:, None]
        n = len(self.langs)
        member = member[:, :n] | member[:, n:]
        return Filter(self.grams, (member << np.arange(n)).sum(axis=1), self.langs)


def to_latin(text: str) -> str:
    return "".join("" if c in "’'" else TO_LATIN.get(c, c) for c in text.lower())


def fit(texts: list[str], labels: list[str], langs: list[str] = LANGS) -> Filter:
    """The filter of labelled texts; twice, the second time with the labels of the first."""
    extra = [to_latin(t) for t, l in zip(texts, labels) if l == "uk"]
    texts, given = [*texts, *extra], np.array([langs.index(l) for l in [*labels, *["uk"] * len(extra)]], np.int64)
    model = None
    for least in (FIRST_SHARE, SHARE):
        counts = _Counts(langs)
        for i in range(0, len(texts), FIT_BATCH):
            # with names: as they occur in all languages, their n-grams then tell nothing
            units = Units(texts[i : i + FIT_BATCH], keep_names=True)
            if not units.n:
                continue
            lang = given[i : i + FIT_BATCH][units.row]
            if model is not None:
                hits, total = model.counts(units)
                lang = np.where(hits.max(axis=1) > 0.5 * total, hits.argmax(axis=1), lang)
            for word, h in units.blocks():
                counts.add(units, units.unit_of_word[word], h, lang)
        model = counts.filter(least)
    return model


def sample(df: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS, least: int = LANGUAGE_ROWS, langs: list[str] = LANGS) -> tuple[list[str], list[str]]:
    """Texts and languages of labelled rows: the `rows` of smallest hash of key, and of each language the first `least` at least.

    Distinct rows are counted by language first; the counts give a bound for the hashes, and only rows below it are
    gathered: little more than what is taken, however many partitions there are. Rows of equal hash count once.
    """
    named = df.select(F.col(text).alias("t"), label_language(F.col(label)).alias("l"), F.xxhash64(F.lit(7), key).alias("h")).where(F.col("l").isin(langs) & (F.length("t") > 0))
    n = {r["l"]: r["n"] for r in named.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # a row for each language
    every = smallest(sum(n.values()), rows)
    share = F.lit(every)
    for l, of in n.items():
        share = F.when(F.col("l") == l, max(every, smallest(of, least))).otherwise(share)
    got = sorted(named.where(below(F.col("h"), share)).groupBy("h").agg(F.min(F.struct("t", "l")).alias("s")).select("h", "s.t", "s.l").collect())
    # the first of all, and the first of each language
    there: Counter = Counter()
    out = []
    for i, r in enumerate(sorted(got, key=lambda r: (r["h"], r["t"]))):
        there[r["l"]] += 1
        if i < rows or there[r["l"]] <= least:
            out.append(r)
    return [r["t"] for r in out], [r["l"] for r in out]


#: A unit's language counts if this share of its n-grams is known in it and the second is this much less.
KNOWN, MARGIN = 0.45, 0.12
#: Share of a word's n-grams that a language knows at least for the word to count.
MOSTLY = 0.6
#: Words that a sentence of another language has at least.
WORDS = 3
#: n-grams that it has beyond those of the text's main language: this many, or half of that and this share.
CLEAR, CLEAR_SHARE = 10.0, 0.5


def segments(units: Units, model: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language (-1: none), confidence and corrected hits of each unit."""
    hits, total = model.counts(units)
    if not len(hits):
        return np.zeros(0, np.int64), np.zeros(0), hits
    top = np.sort(hits, axis=1)
    known = top[:, -1] / np.maximum(1, total)
    margin = (top[:, -1] - top[:, -2]) / np.maximum(1e-9, top[:, -1])
    lang = np.where((known >= KNOWN) & (margin >= MARGIN), hits.argmax(axis=1), -1)
    return lang, np.clip(margin, 0, 1) * np.clip(known, 0, 1), hits


OUT = "lang string, confidence double, languages array<string>, segments array<struct<start:int,stop:int,lang:string,confidence:double>>"


def detect(df: DataFrame, keep: list[str], text: str, model: Filter, open_end: bool = False) -> DataFrame:
    """open_end: the last line may be a sentence without a mark at its end (as in questions typed in haste).

    The columns of keep, the main language and confidence, the languages with a full sentence, and the stretches (start, stop in code points)."""
    if {"lang", "confidence", "languages", "segments"} & set(keep):
        raise ValueError("columns to keep must not be named as the results")
    shared = df.sparkSession.sparkContext.broadcast(model)
    langs = model.langs
    names = np.array([*langs, None], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, len(keep))):
            n = len(batch)
            units = Units(batch.column(len(keep)).to_pylist())
            lang, conf, hits = segments(units, shared.value)
            row = units.row
            whole = np.zeros((n, len(langs)))
            np.add.at(whole, row, hits)
            top = np.sort(whole, axis=1)
            main = np.where(top[:, -1] > 0, whole.argmax(axis=1), -1)
            sure = np.where(top[:, -1] > 0, (top[:, -1] - top[:, -2]) / np.maximum(1e-9, top[:, -1]), 0.0)
            own = main[row]
            # a sentence in another language than the text's has to differ clearly from it
            beyond = hits.max(axis=1, initial=0) - np.where(own >= 0, hits[np.arange(len(row)), np.maximum(own, 0)], 0)
            clear = (lang == own) | (beyond >= CLEAR) | ((beyond >= CLEAR_SHARE * hits.max(axis=1, initial=0)) & (beyond >= CLEAR / 2))
            whole_line = units.last & (units.words >= 5) if open_end else False
            full = (units.full | whole_line) & (units.words >= WORDS) & (lang >= 0) & clear
            has = np.zeros((n, len(langs)), bool)
            has[row[full], lang[full]] = True
            none = ~has.any(axis=1) & (main >= 0)
            has[none, main[none]] = True
            languages = [[langs[l] for l in np.flatnonzero(h)] for h in has]
            spans = [[] for _ in range(n)]
            last = {}
            for i in np.flatnonzero(lang >= 0):  # neighbouring units of one language are one stretch
                r, l = row[i], lang[i]
                if r in last and last[r]["lang"] == langs[l]:
                    k = last[r]
                    k["stop"], k["confidence"] = units.end[i], max(k["confidence"], float(conf[i]))
                else:
                    last[r] = {"start": units.start[i], "stop": units.end[i], "lang": langs[l], "confidence": float(conf[i])}
                    spans[r].append(last[r])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names[main], pa.string()), pa.array(sure), pa.array(languages, pa.list_(pa.string())), pa.array(spans, kind)],
                names=[*keep, "lang", "confidence", "languages", "segments"],
            )

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, {OUT}")
