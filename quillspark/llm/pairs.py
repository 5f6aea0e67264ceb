"""Defective question-answer pairs (problem 5).

Several noisy labelling functions vote on each defect (1 defect, 0 none, -1 where their evidence is silent). Their evidence is of
different kinds: patterns of declining, odds of words learnt from all turns, whether anything specific is said; likeness of words, of letters and
of their order, and whether the answer asks; the mark at the end, broken structure, and whether the last word ever
ends a sentence; n-grams and function words of languages. Per defect, expectation-maximisation fits a label model: the share of
defective rows and each function's rates of votes given the true state, starting from the share of positive votes. Only the numbers of rows
with each combination of votes reach the driver (at most 3^functions per defect, whatever
the input), and the posterior of each combination is looked up by its place in an array of that size.

A defect is kept if its posterior exceeds its cutoff; a row may keep several. The single defect
of p5_found is the one that explains the row best: in the order of DEFECTS.

Answers of any length are looked at whole. One in the language that the question asks for is no other_language.
Defined results: a null or invisible answer is empty. A null or invisible question copies nothing
and has no language. Rows delivered twice give one result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.conversations import visible
from quillspark.llm.language import Filter, Units, slices, to_latin
from quillspark.llm.readability import function_words
from quillspark.llm.words import Words, likeness
from quillspark.session import cut, stored

DEFECTS = ["empty", "copy", "refusal", "truncated", "other_language"]
#: Chosen on one half of planted defects and validated on the other (tests/llm/test_pairs.py); the posteriors lie so far apart that all from 0.3 to 0.8 do alike.
CUTOFFS = {"empty": 0.5, "copy": 0.5, "refusal": 0.5, "truncated": 0.5, "other_language": 0.5}
#: What stands where there is no answer.
PLACEHOLDER = r"^[\[(<{]?(n/?a|null|none|nil|nan|tbd|tba|todo|undefined|empty|no answer|kein|brak|немає|нет ответа)[\])>}]?$"
#: Words by which one declines or has nothing to say, in the five languages.
DECLINE = [
    r"(can ?not|can't|could not|couldn't|unable to|not able to) (answer|help|assist|provide|respond|discuss|comment|find|do that|share)", r"(must|have to) (decline|refuse)", r"not (have )?(permission|allowed|permitted)", r"do(es)? not allow me",
    r"won't (comment|answer|discuss|say)", r"^no comment", r"(have|has) no answer", r"nothing i have been given", r"outside what i may", r"(rather|prefer) not (say|answer|comment|discuss)", r"but i can't",
    r"не мож(у|емо) (відповісти|допомогти|надати|обговорювати|коментувати)", r"не в змозі", r"(змушений|мушу) відмовити", r"не дозволено", r"не дозволяють", r"не маю права", r"коментувати не буду", r"^без коментарів", r"відповіді не маю", r"нічого про це не знайдено", r"нічого не казатиму", r"виходять за межі того",
    r"не мо(гу|жем) (ответить|с этим помочь|помочь|предоставить|обсуждать)", r"не в состоянии", r"(вынужден|должен) отказать", r"не разрешено", r"не позволяют", r"не вправе", r"комментировать не буду", r"^без комментариев", r"ответа (у меня )?нет|ответа не имею", r"ничего об этом не найдено", r"(не скажу|ничего не (буду говорить|говорить|скажу))", r"выходят за рамки того",
    r"nie mog(ę|e) (odpowiedzieć|w tym pomóc|pomóc|udzielić|omawiać)", r"nie jestem w stanie", r"muszę odmówić", r"nie wolno mi", r"nie pozwalają", r"nie mam prawa", r"nie będę komentować", r"^bez komentarza", r"nie mam odpowiedzi", r"nic na ten temat nie znaleziono", r"(wolę|wolałbym|lepiej) nic nie (mówić|powiem)", r"wykracza(ją)? poza to|poza tym, czym",
    r"kann (ich )?(diese frage )?nicht (beantworten|helfen)|dabei kann ich nicht", r"nicht in der lage", r"(muss|müssen) (die antwort )?ablehnen", r"nicht erlaubt", r"lassen eine antwort nicht zu", r"darf ich (solche|keine|dazu)", r"äußere ich mich nicht", r"^kein kommentar", r"habe ich keine antwort|keine antwort", r"dazu in den dokumenten nichts gefunden|nichts gefunden", r"(sage|möchte) ich (lieber|dazu) nichts|lieber nichts", r"(liegt|liegen|geht|gehen) (über das hinaus|außerhalb)",
]
#: Words of which every pattern of DECLINE holds one; the patterns are tried only where one occurs.
CUES = (
    "cannot not t unable decline refuse comment answer nothing outside не відмовити без нічого межі отказать ответа ничего рамки nie odmówić bez nic poza nicht ablehnen keine kein nichts darf äußere außerhalb hinaus"
    " ne vidmovyty nichoho mezhi"
).split()
#: Courtesies and referrals that may stand beside a refusal.
COURTESY = [
    r"^(hello|hi|hm|thank you for|thanks for|i see why|i understand|have a nice|please (ask|contact)|is there anything|sorry[.!]?$|better ask)", r"^(вітаю|добрий день|дякую|гм|розумію|гарного|зверніться|краще зверніться|чи можу|звертайтеся)",
    r"^(здравствуйте|добрый день|спасибо|хм|понимаю|хорошего|обратитесь|лучше обратитесь)", r"^(dzień dobry|witam|dziękuję|hm|rozumiem|miłego|proszę zwrócić|lepiej proszę|czy mogę)",
    r"^(guten tag|hallo|danke|hm|ich verstehe|schönen tag|bitte (wenden|fragen)|kann ich sonst)",
]
#: How one asks for a language: a preposition or an adverb before its name, or the name in the instrumental case.
ASKS_LANGUAGE = {
    "en": r"\b(in|into|to) english|\bauf englisch|ins englische|po angielsku|na angielski|англійською|на англійськ|на английск|по-английски|anhliiskoiu|english,? please",
    "uk": r"\b(in|into|to) ukrainian|\bauf ukrainisch|ins ukrainische|po ukraińsku|na ukraiński|українською|на українськ|на украинск|по-украински|ukrainskoiu|ukrainian,? please",
    "ru": r"\b(in|into|to) russian|\bauf russisch|ins russische|po rosyjsku|na rosyjski|російською|на російськ|на русск|по-русски|rosiiskoiu|russian,? please",
    "pl": r"\b(in|into|to) polish|\bauf polnisch|ins polnische|po polsku|na polski|польською|на польськ|на польск|по-польски|polskoiu|polish,? please",
    "de": r"\b(in|into|to) german|\bauf deutsch|ins deutsche|po niemiecku|na niemiecki|німецькою|на німецьк|на немецк|по-немецки|nimetskoiu|german,? please",
}
#: Marks of a question repeated.
REPEATS = re.compile(r"^\W*(question|query|re|q|frage|питання|вопрос|pytanie)\b\W*", re.I)
#: The seeds that a statistic of refusals needs at least, the parts that answers are dealt into for its limits, the scores of answers a unit and the farthest, and the words that a task holds at once while counting.
SEEDS, PARTS, STEPS, FARTHEST, HELD = 10, 8, 256, 64, 2**20
CYRILLIC = re.compile("[\u0400-\u04ff]")
#: Closing marks and blanks that may follow the last word.
CLOSERS = " \t\r\n\u00a0*_\"'”“»)]`~"


def _with_latin(patterns: list[str]) -> str:
    """All patterns and the Latin spelling of the Cyrillic ones as one expression."""
    cyrillic = [p for p in patterns if any("Ѐ" <= c <= "ӿ" for c in p)]
    return "|".join([*patterns, *(to_latin(p) for p in cyrillic)])


def _tail(text: Column) -> Column:
    """The text without white space, links, emoji and closing marks of emphasis and quotation at its end."""
    out = F.regexp_replace(text, r"(?s)[\s​​-‏﻿\xa0]+$", "")
    out = F.regexp_replace(out, r"(\s*(<?https?://\S+>?|\[[^\]\n]*\]\([^)\n]*\)|[\p{So}\p{Sk}️‍]+))+\s*$", "")
    return F.regexp_replace(out, r"[*_\"'”“»)\]]+$", "")


def _kinds(low: Column) -> Column:
    """What each sentence of an answer is: 1 declines, 2 is a courtesy, 0 is anything else; [0] where no word of a refusal occurs."""
    decline, courtesy = _with_latin(DECLINE), _with_latin(COURTESY)
    sentences = F.filter(F.split(F.regexp_replace(low, r"[*_>\"“”„]", ""), r"(?<=[.!?…])\s+"), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    # the long expression is tried only on sentences that hold a cue
    cue = rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(CUES)})(?:[^\p{{L}}\p{{N}}]|$)"
    kinds = F.transform(sentences, lambda s: F.when(s.rlike(cue) & s.rlike(decline), 1).when(s.rlike(courtesy), 2).otherwise(0))
    return F.when(F.arrays_overlap(_tokens(low), F.array(*map(F.lit, CUES))), kinds).otherwise(F.array(F.lit(0)))


def _tokens(low: Column) -> Column:
    return F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _low(text: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+", " ")))


def _forms(rows: DataFrame) -> DataFrame:
    """rows (with _kinds) with the forms of the answer that the functions look at, each made once."""
    a = F.coalesce("answer", F.lit(""))
    one = rows.withColumns({"_a": a, "_vis": F.coalesce(visible(F.col("answer")), F.lit("")), "_low": _low("answer"), "_end": _tail(a)})
    one = one.withColumn("_tokens", _tokens(F.col("_low")))
    return one.withColumns({
        "_words": F.size("_tokens"),
        "_lines": F.size(F.split("_end", "\n")), "_prior": F.coalesce(F.get(F.split("_end", "\n"), F.size(F.split("_end", "\n")) - 2), F.lit("")),
        "_last": F.trim(F.element_at(F.split(F.regexp_replace("_a", r"\s+$", ""), "\n"), -1)),
    })


def _votes() -> dict[str, list[Column]]:
    """The functions' votes on the columns of _forms and _evidence, by defect; each is -1 where its evidence is silent."""
    c = F.col
    vote = lambda yes, no=None: F.when(yes, 1).when(F.lit(True) if no is None else no, 0).otherwise(-1)
    level = lambda x, low, high: F.when(x >= high, 1).when(x <= low, 0).otherwise(-1)
    vis, end, last, words = c("_vis"), c("_end"), c("_last"), c("_words")
    placeholder = F.lower(vis).rlike(PLACEHOLDER)
    nothing = (vis == "") | vis.rlike(r"^[\p{P}\p{S}]+$") | placeholder

    # copies: words, letters and order are as the question's (no answer much longer or shorter is), and the answer asks
    alike = lambda x, low, high: F.when(nothing | ~c("near"), 0).otherwise(level(c(x), low, high))
    asks = F.when(nothing | ~c("near"), 0).when(end.endswith("?") | c("_a").rlike(r"\?[\s\p{P}]*$"), 1).when(end.rlike(r"[.!;]$"), 0).otherwise(-1)

    # refusals: patterns where there are any, the odds of the words, and that nothing specific is said
    declines = F.array_contains("_kinds", 1)
    pattern = F.when(declines, F.when(F.array_contains("_kinds", 0), 0).otherwise(1)).otherwise(-1)
    first = F.coalesce(F.get(F.filter("_kinds", lambda k: k != 2), F.lit(0)), F.lit(0))
    specific = c("_a").rlike(r"\d|https?:|```|(?m)^\s*([-*•]\s|\||#)") | (words > 60)
    plain = F.when(nothing | specific, 0).when(words.between(3, 30), 1).otherwise(-1)

    # truncation: how the text ends
    stopped = end.rlike(r"[.!?…:;。]$") | c("_a").rlike(r"[.!?…][\"'”“»)\]*_]*\s*$")
    fence = F.regexp_count(c("_a"), F.lit("```")) % 2 == 1
    whole_fence = last.rlike("^```$") & ~fence
    item = last.rlike(r"^([-*•]|\d+[.)])\s+\S") & (c("_lines") > 1)
    bare = last.rlike(r"^([-*•]|\d+[.)])$") & (c("_lines") > 1)
    row = last.rlike(r"^\|")
    cells = lambda t: F.regexp_count(t, F.lit(r"\|"))
    broken_row = row & ((cells(last) < cells(c("_prior"))) | ~last.endswith("|"))
    broken = fence | bare | broken_row
    prose = ~item & ~row & ~whole_fence & ~fence & ~nothing & ~bare
    opened = cells_of(end, r"\(") > cells_of(c("_a"), r"\)")
    short = (words <= 4) & (c("_lines") == 1)
    open_prose = prose & ~stopped
    ending = F.when(nothing, 0).when(broken, 1).when(stopped | whole_fence, 0).when(open_prose & ~short, 1).when(item | row, 0).otherwise(-1)
    structure = F.when(broken | (opened & open_prose), 1).when(nothing | whole_fence | (row & ~broken_row), 0).otherwise(-1)
    last_word = F.when(broken, -1).when(nothing | stopped | whole_fence | row, 0).otherwise(c("final"))
    size = F.when(broken, 1).when(nothing | stopped | whole_fence | item | row | short, 0).when(open_prose & (words >= 8), 1).otherwise(-1)
    silent = lambda x: F.when(nothing, -1).otherwise(x)
    return {
        "empty": [vote(nothing), vote(~vis.rlike(r"[\p{L}\p{N}]") | placeholder), vote(F.length(vis) <= 4, F.length(vis) > 12)],
        "copy": [alike("words_alike", 0.6, 0.8), alike("letters_alike", 0.45, 0.65), alike("order_alike", 0.25, 0.5), asks],
        "refusal": [pattern, F.when(declines, F.when(first == 1, 1).otherwise(0)).otherwise(-1), F.when(nothing | (declines & (words <= 2)), -1).when(words <= 2, 0).otherwise(c("declining")), plain],
        "truncated": [ending, structure, last_word, size],
        "other_language": [F.when(c("excused"), -1).otherwise(silent(c(f"o{i}"))) for i in (1, 2, 3, 4)],
    }


def cells_of(text: Column, mark: str) -> Column:
    return F.regexp_count(text, F.lit(mark))


class Statistics:
    """What words tell, from all turns.

    words: hashes in order; odds: log-odds of each in answers that decline by pattern against those that don't, 0 for any other word; said: 0
    where it often ends a sentence, -1 where that isn't known, 1 (as for any other word) where it hardly ever does; low, high: limits of the
    odds of an answer.
    """

    def __init__(self, words: np.ndarray, odds: np.ndarray, said: np.ndarray, low: float = -np.inf, high: float = np.inf):
        order = np.argsort(words)
        self.words, self.odds, self.said = words[order], odds[order], said[order]
        self.low, self.high = low, high

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words are, and whether they are there."""
        if not len(self.words):
            return np.zeros(len(words), int), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return at, self.words[at] == words

    def score(self, w: Words, part: np.ndarray | None = None) -> np.ndarray:
        """The odds of each text's words, added and set in proportion to the root of their number, in steps of 1 / STEPS. part: whose odds each text has, where there are several."""
        at, known = self.places(w.hash)
        odds = np.zeros(len(at))
        odds[known] = self.odds[at[known]] if part is None else self.odds[at[known], part[w.row[known]]]
        total = np.bincount(w.row, weights=odds, minlength=w.n)
        return np.rint(np.clip(total / np.sqrt(np.maximum(1, w.count)), -FARTHEST, FARTHEST) * STEPS) / STEPS

    def declining(self, w: Words) -> np.ndarray:
        score = self.score(w)
        return np.where(w.count == 0, -1, np.where(score >= self.high, 1, np.where(score <= self.low, 0, -1)))

    def unfinished(self, w: Words, texts: list[str | None]) -> np.ndarray:
        """1 where a text ends in a word that is unknown or hardly ever final, 0 where it often is, -1 if it doesn't end in a word."""
        out = np.full(w.n, -1)
        last = _last(w)
        at, known = self.places(w.hash[last])
        said = np.ones(len(last), int)
        said[known] = self.said[at[known]]
        out[w.row[last]] = said
        return np.where(_open(texts), out, -1)


def _last(w: Words) -> np.ndarray:
    """The places of the last words of texts."""
    return np.flatnonzero(np.r_[w.row[1:] != w.row[:-1], True]) if len(w.row) else np.zeros(0, int)


def _open(texts: list[str | None]) -> np.ndarray:
    """Whether each text ends in a word without a mark."""
    return np.array([bool(t) and t.rstrip(CLOSERS)[-1:].isalpha() for t in texts], bool)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sums of their rows of counts."""
    once, place = np.unique(hashes, return_inverse=True)
    out = [np.bincount(place, weights=c, minlength=len(once)).astype(np.int64) for c in counts.T]
    return once, np.stack(out, axis=1) if len(once) else np.zeros((0, counts.shape[1]), np.int64)


def word_counts(queries: list[str | None], answers: list[str | None], part: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and COUNTS of each: how often it ends a sentence, and stands within one; the answers with it of each part that decline, and don't."""
    found = []
    for texts in (queries, answers):
        w = Words(texts)
        column = np.where(np.isin(w.follows, [ord(c) for c in ".!?…"]), 0, 1)
        asked = np.zeros(len(column), bool)
        last = _last(w)
        asked[last] = _open(texts)[w.row[last]]  # whether a word may stand there is what is asked
        some = (column == 0) | ~asked
        found.append((w.hash[some], column[some]))
    order = np.lexsort((w.hash, w.row))  # a word counts once an answer
    row, word = w.row[order], w.hash[order]
    once = np.r_[True, (row[1:] != row[:-1]) | (word[1:] != word[:-1])] if len(row) else np.zeros(0, bool)
    row, word = row[once], word[once]
    found.append((word, 2 + 2 * part[row] + ~seed[row]))
    words, place = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
    column = np.concatenate([c for _, c in found]).astype(np.int64)
    return words, np.bincount(place * len(COUNTS) + column, minlength=len(words) * len(COUNTS)).reshape(len(words), len(COUNTS))


COUNTS = ["final", "inner", *(f"{state}{i}" for i in range(PARTS) for state in ("yes", "no"))]


def _counted(rows: DataFrame) -> DataFrame:
    """A row for each word of rows (query, answer, part, seed): its hash and COUNTS. Tasks add up their own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        every = lambda: _summed(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
        send = lambda h, c: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, c.T)], names=["word", *COUNTS])
        for batch in (some for whole in batches for some in slices(whole, 1)):
            query, answer, part, seed = (batch.column(i) for i in range(4))
            held.append(word_counts(query.to_pylist(), answer.to_pylist(), part.to_numpy(), seed.to_numpy(zero_copy_only=False)))
            size += len(held[-1][0])
            if size > HELD:
                held = [every()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield send(*held[0])
                    held, size = [], 0
        if held:
            yield send(*every())

    counts = ", ".join(f"{c} long" for c in COUNTS)
    each = rows.select("query", "answer", "part", "seed").mapInArrow(run, f"word long, {counts}")
    return each.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def _scores(rows: DataFrame, stats: Statistics) -> dict[bool, dict[float, int]]:
    """How many answers have each score, by the odds that stand for their part, of those that are seeds and of those that aren't."""
    shared = rows.sparkSession.sparkContext.broadcast(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole, 0)):
            w = Words(batch.column(0).to_pylist())
            seed = batch.column(2).to_numpy(zero_copy_only=False)
            scores = shared.value.score(w, batch.column(1).to_numpy())
            for state in (True, False):
                score, n = np.unique(scores[(w.count > 0) & (seed == state)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), state)), pa.array(score), pa.array(n)], names=["seed", "score", "n"])

    counted = rows.select("answer", "part", "seed").mapInArrow(run, "seed boolean, score double, n long").groupBy("seed", "score").agg(F.sum("n").alias("n")).collect()  # scores, not rows: 4 * FARTHEST * STEPS at most
    return {state: {r["score"]: r["n"] for r in counted if r["seed"] == state} for state in (True, False)}


def limits(good: dict[float, int], rest: dict[float, int]) -> tuple[float, float]:
    """The limits of the odds of an answer, from the numbers of seeds (good) and of other answers with each score.

    Between them is the limit of fewest errors, each class with the same weight; near it there is no say.
    """
    if not good or not rest:
        return -np.inf, np.inf

    def under(n: dict[float, int], at: np.ndarray) -> np.ndarray:
        """The share with a score below each of at."""
        score = np.array(sorted(n))
        sums = np.r_[0, np.cumsum([n[x] for x in score])]
        return sums[np.searchsorted(score, at)] / sums[-1]

    def middle(n: dict[float, int]) -> float:
        score = np.array(sorted(n))
        sums = np.cumsum([n[x] for x in score])
        return float(score[np.searchsorted(sums, [(sums[-1] - 1) // 2, sums[-1] // 2], side="right")].mean())

    at = np.array(sorted({*good, *rest}))
    missed, wrong = under(good, at), 1 - under(rest, at)
    least = int(np.argmin(missed + wrong))
    # few seeds leave it uncertain by a standard error; of the limits within it, the one that takes the fewest other answers for refusals
    error = np.sqrt(max(missed[least] * (1 - missed[least]), 1 / sum(good.values())) / sum(good.values()))
    limit, margin = at[np.flatnonzero(missed + wrong <= missed[least] + wrong[least] + error)[-1]], 0.1 * (middle(good) - middle(rest))
    return float(limit - margin), float(limit + margin)


def statistics(rows: DataFrame) -> Statistics:
    """Fitted on all rows (id, query, answer, _kinds); seeds are the answers that decline by pattern and say nothing else.

    The words of all rows are counted by their hashes, and only words that tell something reach the driver. For the limits, the answers of each of PARTS
    parts have the scores by odds that were fitted on all other parts; then the odds are fitted on all.
    """
    seed = F.array_contains("_kinds", 1) & ~F.array_contains("_kinds", 0)
    rows = rows.select("query", "answer", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(PARTS)).cast("int").alias("part"), seed.alias("seed"))
    n = {(r["part"], r["seed"]): r["count"] for r in rows.groupBy("part", "seed").count().collect()}
    of = lambda state, parts: sum(n.get((i, state), 0) for i in parts)
    every = range(PARTS)
    enough = min(of(True, every), of(False, every)) >= SEEDS

    def odds(parts: Iterable[int]) -> Column:
        yes, no = (sum((F.col(f"{state}{i}") for i in parts), F.lit(0)) for state in ("yes", "no"))
        x = F.log((yes + 0.2) / (max(1, of(True, parts)) + 0.4)) - F.log((no + 0.2) / (max(1, of(False, parts)) + 0.4))
        # a word that is rare in both tells nothing yet
        return F.when(F.lit(enough) & (yes + no >= 3), F.least(F.greatest(x, F.lit(-3.0)), F.lit(3.0))).otherwise(0.0).cast("float")

    seen = F.col("final") + F.col("inner")
    said = F.when((seen == 0) | ((F.col("final") == 0) & (seen >= 3)), 1).when(F.col("final") >= 0.1 * seen, 0).otherwise(-1)
    others = [odds([j for j in every if j != i]).alias(f"but{i}") for i in every]
    told = _counted(rows).select("word", said.cast("byte").alias("said"), odds(every).alias("odds"), *others).where(f"said != 1 OR odds != 0 OR {' OR '.join(f'but{i} != 0' for i in every)}").toArrow()
    word, said, both, *others = (column.to_numpy() for column in told.columns)
    word = word.view(np.uint64)
    low, high = limits(*_scores(rows, Statistics(word, np.stack(others, axis=1), said)).values()) if enough else (-np.inf, np.inf)
    return Statistics(word, both, said, low, high)


#: Numbers of letters of question and answer that are alike enough for a copy.
NEAR = (0.7, 1.45)
EVIDENCE = "near boolean, words_alike double, letters_alike double, order_alike double, declining int, final int, said string, o1 int, o2 int, o3 int, o4 int"


def _evidence(turns: DataFrame, model: Filter, stats: Statistics) -> DataFrame:
    """turns (id, query, answer, other columns) with EVIDENCE: likeness of question and answer, odds of words, language of the answer and votes on it."""
    shared = turns.sparkSession.sparkContext.broadcast((model, stats))
    keep = turns.columns
    q_at, a_at = keep.index("query"), keep.index("answer")

    def hits_of(texts: list[str | None], model: Filter) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each language in each text; languages that lead in one of its units."""
        units = Units(texts)
        hits, _ = model.counts(units)
        whole, leads = np.zeros((len(texts), len(model.langs))), np.zeros((len(texts), len(model.langs)), bool)
        if units.n:
            np.add.at(whole, units.row, hits)
            top = hits.max(axis=1)
            lead = np.flatnonzero((top >= 2) & (units.words >= 2))
            leads[units.row[lead], hits[lead].argmax(axis=1)] = True
        return whole, leads

    def languages(questions: list, answers: list, model: Filter, few: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(language of the answer, three votes on its being another one than the question's)."""
        q, q_leads = hits_of(questions, model)
        a, _ = hits_of(answers, model)
        most = q.max(axis=1, initial=0)
        q_leads |= (q >= 0.5 * most[:, None]) & (most[:, None] >= 2)  # where it isn't clear, any of them
        best = a.max(axis=1, initial=0)
        own = np.where(q_leads, a, -1).max(axis=1, initial=-1)
        known = q_leads.any(axis=1) & (best >= 2)
        beyond = best - np.maximum(own, 0)
        strong = known & (beyond >= 12) & (beyond >= 0.3 * best)
        some = known & (beyond >= 10) & (beyond >= 0.5 * best)
        # a few words can belong to two languages of one script, unless they are known in one alone
        script = np.array([bool(CYRILLIC.search(x or "")) != bool(CYRILLIC.search(y or "")) for x, y in zip(answers, questions)], bool)
        known &= ~few | script | ((own <= 0) & (best >= 8))
        some, strong = some & known, strong & known
        same = known & (beyond <= 0)
        said = np.where(best >= 2, a.argmax(axis=1) if a.size else -1, -1)
        return said, [np.where(some, 1, np.where(known, 0, -1)), np.where(strong, 1, np.where(same, 0, -1)), np.where(known & (own <= 0.35 * best), 1, np.where(known & (own >= 0.8 * best), 0, -1))]

    def spoken(w: Words) -> np.ndarray:
        """The language of most function words of each text, -1 where it isn't clear."""
        n = np.stack([np.bincount(w.row[np.isin(w.hash, words)], minlength=w.n) for words in function_words()], axis=1)
        by = np.stack([n[:, i].max(axis=1) for i in ([0], [3, 4], [5], [2], [1])], axis=1)  # en, uk (also in Latin letters), ru, pl, de
        top = np.sort(by, axis=1)
        return np.where((top[:, -1] >= 2) & (top[:, -1] >= 2 * top[:, -2]), by.argmax(axis=1), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, stats = shared.value
        names = np.array([*model.langs, None], dtype=object)
        for batch in (part for whole in batches for part in slices(whole, a_at)):
            questions, answers = batch.column(q_at).to_pylist(), batch.column(a_at).to_pylist()
            n = len(batch)
            q, a = Words(questions), Words(answers)
            near = (q.letters >= 3) & (a.letters >= NEAR[0] * q.letters - 3) & (a.letters <= NEAR[1] * q.letters + 12)
            # only answers of about the question's length are compared with it
            left = Words([x if k else None for x, k in zip(questions, near)])
            right = Words([REPEATS.sub("", x) if k and x else None for x, k in zip(answers, near)])
            every = np.ones(n, bool)
            alike = [likeness(n, (left.row, left.hash), (right.row, right.hash)), likeness(n, left.grams(every), right.grams(every)), likeness(n, left.pairs(), right.pairs())]
            alike[2] = np.where(np.minimum(left.count, right.count) < 2, alike[0], alike[2])  # one word has no order
            said, votes = languages(questions, answers, model, a.count <= 4)
            qs, as_ = spoken(q), spoken(a)
            votes.append(np.where((qs < 0) | (as_ < 0), -1, qs != as_))
            numbers = [stats.declining(a), stats.unfinished(a, answers)]
            columns = [pa.array(near), *(pa.array(x) for x in alike), *(pa.array(x.astype(np.int32)) for x in numbers), pa.array(names[said], pa.string()), *(pa.array(v.astype(np.int32)) for v in votes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*keep, *(f.split()[0] for f in EVIDENCE.split(", "))])

    fields = ", ".join(f"`{c}` {turns.schema[c].dataType.simpleString()}" for c in keep)
    return turns.mapInArrow(run, f"{fields}, {EVIDENCE}")


def fit_labels(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each combination of votes, by expectation-maximisation on their numbers."""
    if not patterns:
        return {}
    votes = np.array(list(patterns))
    n = np.array(list(patterns.values()), float)
    said = votes >= 0
    share = np.where(said, votes, 0).sum(axis=1) / np.maximum(1, said.sum(axis=1))
    post = np.clip(share, 0.02, 0.98)
    for _ in range(rounds):
        rate = min(0.5, max(1e-4, float((n * post).sum() / n.sum())))
        odds = np.full(len(n), np.log(rate / (1 - rate)))
        for f in range(votes.shape[1]):
            good, says = np.zeros(2), np.zeros(2)
            for state, weight in ((1, n * post), (0, n * (1 - post))):
                own = weight * said[:, f]
                # a prior of a few votes on a better than even function keeps the states from changing places
                good[state] = np.clip(((own * (votes[:, f] == state)).sum() + 4) / (own.sum() + 5), 0.55, 0.995)
                says[state] = ((weight * (votes[:, f] == 1)).sum() + (0.8 if state else 0.5)) / (weight.sum() + (1 if state else 5))
            # a function that mostly is silent on good rows says much by a yes; its silence says nothing
            yes = max(np.log(good[1] / (1 - good[0])), min(np.log(says[1] / says[0]), np.log(200)))
            no = np.log((1 - good[1]) / good[0])
            odds += np.where(votes[:, f] == 1, yes, np.where(votes[:, f] == 0, no, 0))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    return {p: float(x) for p, x in zip(patterns, post)}


def _place(votes: Column, n: int) -> Column:
    """The place of a combination of votes among all 3^n, from 0."""
    return F.aggregate(votes, F.lit(0), lambda acc, v: acc * 3 + v + 1)


def _combination(place: int, n: int) -> tuple[int, ...]:
    return tuple(place // 3 ** (n - 1 - i) % 3 - 1 for i in range(n))


def label(turns: DataFrame, model: Filter) -> DataFrame:
    """id and the posterior of each defect (a column each) of each row."""
    once = turns.select("id", "query", "answer").where(F.col("id").isNotNull()).distinct().withColumn("_kinds", _kinds(_low("answer")))
    rows = turns.sparkSession.read.schema(once.schema).parquet(stored(once))  # read three times: words, limits, votes
    found = _evidence(rows, model, statistics(rows))
    asked = F.lower(F.coalesce("query", F.lit("")))
    excused = F.coalesce(F.exists(F.array(*(F.when(asked.rlike(p), F.lit(l)) for l, p in ASKS_LANGUAGE.items())), lambda l: l == F.col("said")), F.lit(False))
    votes = _votes()
    # one pass over the rows; a number says how the functions of a defect voted
    voted = _forms(found.withColumn("excused", excused)).select("id", *(_place(F.array(*votes[d]), len(votes[d])).alias(d) for d in DEFECTS)).distinct()
    keyed = cut(voted)
    each = keyed.select(F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).alias("p")) for d in DEFECTS))).alias("v")).groupBy("v.d", "v.p").count()
    counted = each.collect()  # combinations of a defect's votes, not rows: 81 a defect at most
    out = {}
    for d in DEFECTS:
        n = len(votes[d])
        post = fit_labels({_combination(r["p"], n): r["count"] for r in counted if r["d"] == d})
        out[d] = F.get(F.array(*(F.lit(post.get(_combination(i, n), 0.0)) for i in range(3**n))), F.col(d))
    return keyed.select("id", *(x.alias(d) for d, x in out.items()))


def defects(labelled: DataFrame) -> DataFrame:
    """id, defect, posterior of every defect whose posterior exceeds its cutoff."""
    each = F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("posterior"), F.lit(i).alias("order")) for i, d in enumerate(DEFECTS)))
    kept = F.filter(each, lambda x: F.element_at(F.create_map(*(y for d in DEFECTS for y in (F.lit(d), F.lit(CUTOFFS[d])))), x["defect"]) < x["posterior"])
    return labelled.select("id", F.explode(kept).alias("d")).select("id", "d.defect", "d.posterior", "d.order")
