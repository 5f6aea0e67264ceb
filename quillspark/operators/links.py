"""Links in texts: extraction with labels, contexts and keywords, search and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.fixed import ABBREVIATIONS, LINK_STOP
from quillspark.operators.matching import contains
from quillspark.session import cut

#: Sets of keywords up to which what is found for them goes to every task.
MOST_SETS = 2000
#: The four forms of links, in the order in which a label is taken from: image, labelled, automatic, bare.
FORMS = [(r"!\[([^\]]*)\]\(([^)]+)\)", "labelled"), (r"(?<!!)\[([^\]]+)\]\(([^)]+)\)", "labelled"), (r"<(https?://[^>]+)>", "plain"), (r"(?<![(\[\"'])(https?://[^\s\"'<>)\[\]]+)", "plain")]

def with_abbreviations(words: Column) -> Column:
    """Each word followed by its other spellings, without repetition."""
    pairs = F.create_map(*(x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(pairs, w), F.array().cast("array<string>"))))))


def tokens(text: Column) -> Column:
    return F.filter(T.link_tokens(text), lambda w: ~w.isin(LINK_STOP))


def extract(docs: DataFrame, key: str, text: str, most: int = 300) -> DataFrame:
    """key, url, label, link_type, place, context: each address of a text once, with its longest real label (the url without one).

    Anchors and mail addresses are no links. place counts the characters before the link; context is what stands around it, at most `most` characters.
    Texts are read once, and only what is found is shuffled.
    """
    rows = docs.select(F.col(key), F.col(text).alias("__t")).where(F.col("__t").rlike(r"https?://|\]\("))

    def form(i: int, pattern: str, kind: str) -> Column:
        def one(m: Column, n: Column) -> Column:
            url = F.regexp_extract(m, r"\]\(([^)]+)\)", 1) if kind == "labelled" else F.regexp_replace(m, "^<|>$", "")
            label = F.regexp_extract(m, r"\[([^\]]*)\]", 1) if kind == "labelled" else url
            label = F.when(label == "", "image").otherwise(label) if i == 0 else label
            return F.struct(F.lit(i).alias("form"), n.alias("n"), F.trim(url).alias("url"), F.trim(label).alias("label"), (F.position(m, F.col("__t")) - 1).alias("place"))

        return F.transform(F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)), one)

    links = rows.select(key, "__t", F.explode(F.concat(*(form(i, p, k) for i, (p, k) in enumerate(FORMS)))).alias("l"))
    links = links.select(key, "l.*", context(F.col("__t"), F.col("l.place"), most).alias("context")).where("url <> '' and not startswith(url, '#') and not startswith(url, 'mailto:')")
    links = links.withColumn("label", F.when(F.col("label") == F.col("url"), "").otherwise(F.col("label")))
    w = Window.partitionBy(key, "url").orderBy(F.length("label").desc(), "form", "n")
    best = links.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return best.select(key, "url", F.when(F.col("label") == "", F.col("url")).otherwise(F.col("label")).alias("label"), T.link_type(F.col("url")).alias("link_type"), "place", "context")


def context(text: Column, place: Column, most: int = 300) -> Column:
    """The paragraph around a place if it has 20 to 2 * most characters (cut to most), else half of most to either side."""
    before = F.element_at(F.split(F.left(text, place), r"\n[ \t\r]*\n"), -1)
    after = F.element_at(F.split(F.substr(text, place + 1), r"\n[ \t\r]*\n"), 1)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    paragraph = squeeze(F.concat(before, after))
    low = F.greatest(place - most // 2, F.lit(0))
    window = squeeze(F.substr(text, low + 1, place - low + most // 2))
    return F.when(F.length(paragraph).between(20, 2 * most), F.left(paragraph, F.lit(most))).otherwise(window)


def keywords(label: Column, url: Column, near: Column, most: int = 50) -> Column:
    """Words of label, host and path, then the 15 most frequent other words around the link."""
    host = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), r"\."), lambda p: (F.length(p) > 2) & ~p.isin("com", "net", "org", "app", "dev", "www"))
    path = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"[/\-_?&#=+]"), lambda p: (F.length(p) > 2) & ~p.rlike(r"^\d+$"))
    own = with_abbreviations(F.concat(tokens(label), F.transform(F.concat(host, path), F.lower)))
    rest = F.filter(tokens(near), lambda w: ~F.array_contains(own, w))
    each = F.array_distinct(rest)
    ranked = F.array_sort(F.transform(each, lambda w: F.struct((-F.size(F.filter(rest, lambda x: x == w))).alias("n"), F.array_position(each, w).alias("p"), w.alias("w"))))
    return F.slice(F.array_distinct(F.concat(own, with_abbreviations(F.transform(F.slice(ranked, 1, 15), lambda s: s["w"])))), 1, most)


def find_by_keywords(links: DataFrame, queries: DataFrame, limit: int = 30) -> DataFrame:
    """query_id, url, id, relevance, rank: links that share a keyword or hold one in label, context or file.

    2 points for a shared keyword, 1 each for label, context and file; one row per url (the most relevant,
    then newest, then id); the first `limit` urls by name, then ranked by relevance.
    links: id, url, label, context, source_file, keywords, created_at; queries: query_id, keywords (few, given by the caller).
    """
    low = F.filter(F.array_distinct(F.transform("keywords", F.lower)), lambda w: F.coalesce(w != "", F.lit(False)))
    # queries with the same keywords find the same links, so links are sought once for each set of keywords
    every = queries.where("keywords is not null").groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(low)))).alias("k"))
    every = every.where(F.size("k") > 0).withColumn("kid", F.to_json("k"))
    sets = cut(every.groupBy("kid").agg(F.first("k").alias("k")))
    few = F.broadcast if sets.count() <= MOST_SETS else (lambda df: df)
    asked = few(sets.select("kid", F.explode("k").alias("w")))
    wanted = sets.select(F.explode("k").alias("w")).distinct()
    fields = ["label", "context", "source_file"]
    hits = []
    for f in fields:
        found = contains(wanted.select(F.col("w").alias("needle")), links.select("id", F.col(f).alias("text")))
        hits.append(found.select("id", F.col("needle").alias("w"), F.lit(f).alias("f"), F.lit(1).alias("points")))
    listed = links.select("id", F.explode(F.array_distinct("keywords")).alias("w"), F.lit("keywords").alias("f"), F.lit(2).alias("points"))
    held = listed.join(few(wanted), "w", "left_semi").select("id", "w", "f", "points")
    for h in hits:
        held = held.unionByName(h)
    scored = held.join(asked, "w").select("kid", "id", "f", "points").distinct().groupBy("kid", "id").agg(F.sum("points").cast("int").alias("relevance"))
    full = scored.join(links.select("id", "url", "created_at"), "id")
    w = Window.partitionBy("kid", "url").orderBy(F.desc("relevance"), F.desc("created_at"), "id")
    one = full.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    one = one.withColumn("__u", F.row_number().over(Window.partitionBy("kid").orderBy("url"))).where(F.col("__u") <= limit)
    rank = F.row_number().over(Window.partitionBy("kid").orderBy(F.desc("relevance"), "url"))
    best = one.select("kid", "url", "id", "relevance", rank.alias("rank"))  # `limit` a set at most
    return every.select("query_id", "kid").join(few(best), "kid").select("query_id", "url", "id", "relevance", "rank")


def score(query: Column, keywords: Column, label: Column, near: Column, file: Column, own: Column, kind: Column) -> Column:
    """10 if the question holds the label; for each keyword 3 if a link keyword begins with it, 2 for the label, 1 for context and file; 5 for a wanted kind."""
    q, l, c, f = F.lower(query), F.lower(label), F.lower(F.coalesce(near, F.lit(""))), F.lower(F.coalesce(file, F.lit("")))
    own = F.coalesce(own, F.array().cast("array<string>"))
    each = F.aggregate(keywords, F.lit(0), lambda a, k: a + F.when(F.exists(own, lambda o: o.startswith(k)), 3).otherwise(0) + 2 * l.contains(k).cast("int") + c.contains(k).cast("int") + f.contains(k).cast("int"))
    image = (kind == "image") & q.rlike("фото|image|photo|зображ|скрин")
    video = (kind == "video") & q.rlike("відео|video|запис")
    return F.when((l != "") & q.contains(l), 10).otherwise(0) + each + F.when(image | video, 5).otherwise(0)


def query_keywords(query: Column) -> Column:
    """Words of a question that are no stop words, each with its other spellings."""
    bare = F.regexp_replace(F.lower(F.coalesce(query, F.lit(""))), r"[?!.,;:'\"()\[\]]", "")
    return with_abbreviations(F.filter(F.split(bare, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(LINK_STOP)))


def reindexed(links: DataFrame, found: DataFrame) -> DataFrame:
    """links with those of the files in found (same columns, source_file among them) replaced: the old ones of these files go, the new ones come."""
    files = found.select("source_file").where("source_file is not null").distinct()
    return links.join(files, "source_file", "left_anti").select(*links.columns).unionByName(found.select(*links.columns))


def find(links: DataFrame, queries: DataFrame, least: int, wishes: list[str] | None = None, limit: int = 30) -> DataFrame:
    """query_id, found, links, block of each question (query_id, query): the valid links of `least` points and more, best first, as lines "label**: url".

    wishes: patterns of questions that ask for a link; with them only such questions are searched, and those count as found even if there is nothing.
    Without them any question with keywords is searched, and found says whether there is something. A model's context takes the block.
    """
    asked = queries.select("query_id", "query", query_keywords(F.col("query")).alias("keywords"), (T.holds_any(F.coalesce("query", F.lit("")), wishes) if wishes is not None else F.lit(True)).alias("asks"))
    searched = asked.where(F.col("asks") & (F.size("keywords") > 0))
    near = find_by_keywords(links, searched.select("query_id", "keywords"), limit)
    full = near.join(links.select("id", "label", "context", "source_file", F.col("keywords").alias("own"), "link_type"), "id").join(searched.select("query_id", "query", "keywords"), "query_id")
    rated = full.where(T.valid_url(F.col("url"))).withColumn("points", score(F.col("query"), F.col("keywords"), F.coalesce("label", F.lit("")), F.col("context"), F.col("source_file"), F.col("own"), F.col("link_type")))
    best = rated.where(F.col("points") >= least).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("p"), "rank", "label", "url"))).alias("l"))  # `limit` at most
    joined = asked.select("query_id", "asks").join(best, "query_id", "left")
    block = F.array_join(F.transform("l", lambda x: F.concat(F.coalesce(x["label"], F.lit("")), F.lit("**: "), x["url"])), "\n")
    found = F.col("asks") if wishes is not None else F.col("l").isNotNull()
    return joined.select("query_id", found.alias("found"), F.coalesce(F.size("l"), F.lit(0)).alias("links"), block.alias("block"))
