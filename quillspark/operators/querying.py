"""From a question to what is searched: expansions, other wordings, keywords, variants. What a model said is a column; null means that it failed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import names, text as T
from quillspark.operators.models import listed


def _none() -> Column:
    return F.array().cast("array<string>")


def latin_question(query: Column) -> Column:
    """The question with its capitalised Cyrillic words of three letters and more in Latin spelling."""

    def one(token: Column) -> Column:
        letters = F.regexp_replace(token, "[^а-яіїєґёэъыА-ЯІЇЄҐ]", "")
        latin = T.to_latin(letters)
        return F.when(token.rlike("^[А-ЯІЇЄҐ]") & (F.length(letters) > 2), F.concat(F.upper(F.left(latin, F.lit(1))), F.substr(latin, F.lit(2)))).otherwise(token)

    return F.array_join(F.transform(F.split(query, r"\s+"), one), " ")


def expanded(query: Column, entity: Column, said: Column, stop: list[str]) -> Column:
    """For a name: the Latin question if it differs, the last and the first of several names (four at most); else three lines of a model's answer at most."""
    latin = latin_question(query)
    called = F.filter(F.split(query, r"\s+"), lambda t: t.rlike("^[А-ЯІЇЄҐA-Z]") & ~F.lower(t).isin(stop))
    ends = F.when(F.size(called) > 1, F.array(F.element_at(called, -1), F.element_at(called, 1))).otherwise(_none())
    own = F.concat(F.when(latin != F.array_join(F.split(query, r"\s+"), " "), F.array(latin)).otherwise(_none()), ends)
    return F.when(entity, F.slice(F.array_distinct(own), 1, 4)).otherwise(listed(said, query, 3))


def rephrased(query: Column, entity: Column, said: Column, more_than: int = 4) -> Column:
    """The lines of a model's answer for questions of more than four words that ask for no name."""
    return F.when(~entity & (F.size(T.words(query)) > more_than), listed(said, query)).otherwise(_none())


def keywords(query: Column, entity: Column, base: Column, said: Column) -> Column:
    """base (as of understanding.expand) with the spellings of names (25 at most), or with what a model listed (20); the first ten of base if it failed."""
    named = F.slice(F.array_distinct(F.concat(base, names.query_name_variants(query))), 1, 25)
    parts = F.filter(F.transform(F.split(said, ","), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    told = F.slice(F.array_distinct(F.concat(base, parts)), 1, 20)
    return F.when(entity, named).when(said.isNull(), F.slice(base, 1, 10)).otherwise(told)


def variants(query: Column, expansions: Column, rewordings: Column, translations: Column | None = None, history: Column | None = None) -> Column:
    """What is searched for a question, itself first: of up to three words with one expansion, else with two and one rewording; then translations and the question in its history, six in all."""
    short = F.size(T.words(query)) <= 3
    own = F.when(short, F.concat(F.array(query), F.slice(expansions, 1, 1))).otherwise(F.slice(F.concat(F.array(query), F.slice(expansions, 1, 2), F.slice(rewordings, 1, 1)), 1, 4))
    out = F.filter(own, lambda v: F.coalesce(v, F.lit("")) != "")
    for more in (translations, history):
        if more is not None:
            out = F.slice(F.array_distinct(F.concat(out, F.filter(F.coalesce(more, _none()), lambda v: F.coalesce(v, F.lit("")) != ""))), 1, 6)
    return out
