"""The port of a language model: a function from prompts to answers, called once a batch, with a second model behind the first."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

Model = Callable[[list[str]], list[str | None]]


def routed(first: Model, second: Model | None = None) -> Model:
    """A model that asks the second one where the first raises or gives no answer; null where both fail. A batch that raises is asked again prompt by prompt."""

    def safely(model: Model, prompts: list[str]) -> list[str | None]:
        try:
            return list(model(prompts))
        except Exception:
            return [None] if len(prompts) == 1 else [a for p in prompts for a in safely(model, [p])]

    def run(prompts: list[str]) -> list[str | None]:
        out = safely(first, prompts) if prompts else []
        left = [i for i, a in enumerate(out) if a is None]
        if second is not None and left:
            for i, a in zip(left, safely(second, [prompts[i] for i in left])):
                out[i] = a
        return out

    return run


def completed(prompt: Column, model: Model) -> Column:
    """The model's answer to each prompt; null for null prompts and failures. Equal prompts of a batch are asked once."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        asked = list(dict.fromkeys(p for p in prompts if p is not None))
        known = dict(zip(asked, model(asked))) if asked else {}
        return prompts.map(lambda p: known.get(p) if p is not None else None).astype(object)

    return run(prompt)


def listed(answer: Column, query: Column | None = None, most: int | None = None) -> Column:
    """The lines of an answer that aren't blank and differ from the question; none for null."""
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda l: F.trim(l))
    kept = F.filter(lines, lambda l: (l != "") if query is None else (l != "") & (l != query))
    return kept if most is None else F.slice(kept, 1, most)


def model_keywords(answer: Column, text: Column, most: int = 20) -> Column:
    """The keywords (3 to 29 characters) of a model's answer, parted by commas or lines; without any the most frequent words of the text."""
    parts = F.transform(F.split(F.coalesce(answer, F.lit("")), "[,\n]"), lambda w: F.lower(F.trim(w)))
    said = F.slice(F.array_distinct(F.filter(parts, lambda w: F.length(w).between(3, 29))), 1, most)
    return F.when(F.size(said) > 0, said).otherwise(F.transform(T.frequent_words(text), lambda w: w["word"]))
