"""From texts to stored chunks: split by a strategy, keywords, embeddings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillspark.functions import names, text as T
from quillspark.operators import chunking
from quillspark.operators.tables import has_url


def embedder(embed: Callable[[list[str]], list] = chunking.hashed_embedding) -> Callable[[Column], Column]:
    """The port of an embedding model as a vectorised function; null where the model gives nothing."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embed(texts.fillna("").tolist()))

    return run


def file_keywords(name: Column, raw: Column, text: Column) -> Column:
    """The most frequent words of the text, words of path, headings and addresses; sane ones only."""
    frequent = F.transform(T.frequent_words(text), lambda w: w["word"])
    return T.sane_keywords(F.array_distinct(F.concat(frequent, T.path_keywords(name), T.header_keywords(raw), T.url_keywords(raw))))


def chunk_keywords(text: Column, title: Column, of_file: Column) -> Column:
    """The 12 most frequent words of a chunk, its section's title and the title's longer words, the first six keywords of the file; sane ones only."""
    own = F.slice(F.transform(T.frequent_words(text), lambda w: w["word"]), 1, 12)
    titled = F.when(title.isNotNull(), F.concat(F.array(title), F.filter(F.split(title, r"\s+"), lambda w: F.length(w) > 2))).otherwise(F.array().cast("array<string>"))
    return T.sane_keywords(F.array_distinct(F.concat(own, titled, F.slice(of_file, 1, 6))))


def ingest(files: DataFrame, strategy: str = "simple", embed: Callable[[list[str]], list] = chunking.hashed_embedding, model: str = "hashed-64", shortest: int = 80) -> DataFrame:
    """Chunks of files (name, raw, text, and path if names may repeat): id, path, file_id, chunk_id, parent_id, level, text, section_title, context_keywords, embedding, model, text_length.

    simple and semantic chunks have no level; of parent-child chunks, parents get no vector, and children stay if they are
    long enough or hold an address. Chunks without a vector, but for parents, are dropped. Null texts give nothing.
    A file's ids begin with its name; where a path was cut to that name or the id is shortened, a digest of the path keeps them apart.
    What belongs to the file goes along with its text, so nothing is joined.
    """
    path = F.col("path") if "path" in files.columns else F.col("name")
    slug = T.file_id(F.col("name"))
    own = F.when((path != F.col("name")) | (F.length(slug) >= 50), F.concat(slug, F.lit("_"), F.left(F.md5(path.cast("binary")), F.lit(8)))).otherwise(slug)
    of_file = F.struct(path.alias("path"), own.alias("file_id"), file_keywords(F.col("name"), F.col("raw"), F.col("text")).alias("keywords"))
    rows = files.where("text is not null").select(of_file.alias("file"), own.alias("file_id"), "text")
    none = F.lit(None).cast("string")
    if strategy == "parent_child":
        parts = chunking.parent_child_chunks(rows, "file", "file_id", "text").select("file", "chunk_id", "parent_id", "level", "section_title", "text")
        parts = parts.where((F.col("level") == 0) | (F.length("text") >= shortest) | has_url(F.col("text")))
    else:
        if strategy == "semantic":
            found = chunking.semantic_chunks(rows, "file", "text", embed).where(F.length("chunk") >= shortest)
        elif strategy == "simple":
            found = chunking.sentence_chunks(rows, "file", "text", shortest=shortest)
        else:
            raise ValueError(f"unknown strategy {strategy}")
        parts = found.select("file", none.alias("chunk_id"), none.alias("parent_id"), F.lit(None).cast("int").alias("level"), none.alias("section_title"), F.col("chunk").alias("text"))
    words = chunk_keywords(F.col("text"), F.col("section_title"), F.col("file.keywords"))
    vector = F.when(~F.col("level").eqNullSafe(F.lit(0)), embedder(embed)(F.col("text")))
    out = parts.withColumns({"context_keywords": names.enriched(words), "embedding": vector, "model": F.lit(model), "text_length": F.length("text")})
    out = out.where(F.col("embedding").isNotNull() | F.col("level").eqNullSafe(F.lit(0)))
    identity = F.coalesce("chunk_id", F.concat("file.file_id", F.lit("_"), F.md5(F.col("text").cast("binary"))))
    return out.select(identity.alias("id"), "file.path", "file.file_id", "chunk_id", "parent_id", "level", "text", "section_title", "context_keywords", "embedding", "model", "text_length")
