"""A property graph as two tables: entities (id, name, type) and edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import entity_id, noisy_entity
from quillspark.operators.matching import contains
from quillspark.session import cut

EXTRACTED = "struct<entities:array<struct<name:string,type:string>>,relations:array<struct<from:string,relation:string,to:string>>>"


def extract(answers: DataFrame, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) from a model's JSON answers: noisy entities, unknown ends and self edges drop out; JSON may stand among other text."""
    parsed = answers.select(key, F.from_json(F.regexp_extract(json, r"(?s)\{.*\}", 0), EXTRACTED).alias("j"))
    named = parsed.select(key, F.explode("j.entities").alias("e")).where("e.name <> '' and e.type <> ''").select(key, F.col("e.name").alias("name"), F.lower("e.type").alias("type"))
    entities = named.where(~noisy_entity(F.col("name"), F.col("type"))).withColumn("id", entity_id(F.col("name"), F.col("type")))
    ids = entities.groupBy(key, F.lower("name").alias("n")).agg(F.max("id").alias("i"))
    edges = parsed.select(key, F.explode("j.relations").alias("r")).select(key, F.lower("r.from").alias("f"), F.lower("r.to").alias("t"), F.upper("r.relation").alias("type")).where("type <> ''")
    edges = edges.join(ids.select(key, F.col("n").alias("f"), F.col("i").alias("src")), [key, "f"]).join(ids.select(key, F.col("n").alias("t"), F.col("i").alias("dst")), [key, "t"])
    return entities.select(key, "id", "name", "type"), edges.where("src <> dst").select(key, "src", "dst", "type").distinct()


def merge(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per entity id (the smallest name), one per edge, and only edges between known entities."""
    one = entities.where("id is not null").groupBy("id").agg(F.min(F.struct("name", "type")).alias("s")).select("id", "s.name", "s.type")
    known = one.select("id")
    kept = edges.select("src", "dst", "type").distinct().join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return one, kept


def find(entities: DataFrame, queries: DataFrame, limit: int = 25) -> DataFrame:
    """query_id, id, name, type of the first `limit` entities (by id) whose name holds a query as a whole."""
    asked = queries.select("query_id", F.lower("query").alias("needle"))
    hits = contains(asked.select("needle"), entities.select("id", F.col("name").alias("text")))
    found = asked.join(hits, "needle").select("query_id", "id").distinct()
    first = found.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("__n") <= limit)
    return first.join(entities.select("id", "name", "type"), "id").select("query_id", "id", "name", "type")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 1, limit: int = 50) -> DataFrame:
    """seed, id, distance: what is reached from each seed over 1..depth edges in either direction, the nearest `limit` (then by id).

    A frontier is joined to the edges once a level, deduplicated and written, so no path is ever enumerated. Nothing that cannot be
    among a seed's nearest is followed: a seed with `limit` ids is done, and of a vertex's neighbours the first 2 * limit + 1 suffice,
    as a seed that is not done has seen at most `limit` of them. So a hub costs no more than any vertex.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    near = both.withColumn("__n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("__n") <= 2 * limit + 1).drop("__n")
    seen = seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    w = Window.partitionBy("seed").orderBy("id")
    for level in range(1, depth + 1):
        step = frontier.join(near, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        new = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("distance", F.lit(level))
        found = cut(new.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n"))
        seen = seen.unionByName(found)
        done = seen.where("distance > 0").groupBy("seed").count().where(F.col("count") >= limit).select("seed")
        frontier = found.join(done, "seed", "left_anti")
    order = Window.partitionBy("seed").orderBy("distance", "id")
    return seen.where("distance > 0").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")


def delete(entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the entities in gone (id) and without edges at either end of them."""
    ids = gone.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return entities.join(ids, "id", "left_anti"), kept.select("src", "dst", "type")


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities, edges, and a map of entities by type; all zero without edges."""
    kinds = entities.groupBy("type").agg(F.countDistinct("id").alias("n"))
    by = kinds.agg(F.sum("n").alias("entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    n = edges.agg(F.count("*").alias("edges"))
    row = by.join(n)  # one row each
    none = F.col("edges") == 0
    return row.select(F.when(none, 0).otherwise(F.col("entities")).alias("entities"), "edges", F.when(none, F.create_map().cast("map<string,bigint>")).otherwise(F.col("by_type")).alias("by_type"))


def render(entities: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """group, block: a sentence for each entity with the kinds of its edges."""
    kinds = edges.select(F.col("src").alias("id"), "type").unionByName(edges.select(F.col("dst").alias("id"), "type")).groupBy("id").agg(F.array_sort(F.collect_set("type")).alias("kinds"))
    line = F.concat("name", F.lit(" is a "), "type", F.coalesce(F.concat(F.lit(" (connected via: "), F.array_join("kinds", ", "), F.lit(")")), F.lit("")))
    rows = entities.join(kinds, "id", "left").select(group, "id", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda s: s["line"]), ". ")
    return rows.groupBy(group).agg(F.concat(joined, F.lit(".")).alias("block"))
