"""Tags, titles, folders, clusters and suggestions (AGG, RNK and JN rows of the inventory)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.functions.text import tag_key, title_tokens
from notelens.sources.tables import Scratch, staged


def duplicate_titles(notes: DataFrame) -> DataFrame:
    """AGG-11: trimmed titles in lower case that several notes have."""
    return notes.groupBy(F.lower(F.trim("title")).alias("title_key")).agg(F.count(F.lit(1)).alias("notes")).filter("notes > 1")


def near_duplicate_tags(tags: DataFrame) -> DataFrame:
    """AGG-10: tag keys with several spellings; tags(tag)."""
    spelt = tags.groupBy(tag_key(F.col("tag")).alias("tag_key")).agg(F.array_sort(F.collect_set("tag")).alias("spellings"))
    return spelt.filter(F.size("spellings") > 1)


def tag_vocabulary(notes: DataFrame, generic: tuple[str, ...] = (), limit: int = 40) -> DataFrame:
    """AGG-6 and SRT-12: the most used tags with their notes; notes(path, tags)."""
    used = notes.select("path", F.explode(F.array_distinct("tags")).alias("tag")).filter(~F.col("tag").isin(*generic) if generic else F.lit(True))
    return used.groupBy("tag").agg(F.count(F.lit(1)).alias("notes")).orderBy(F.col("notes").desc(), "tag").limit(limit)


def crowded_folders(notes: DataFrame, at_least: int = 20, limit: int = 20) -> DataFrame:
    """AGG-7 and SRT-11; notes(folder)."""
    return notes.groupBy("folder").agg(F.count(F.lit(1)).alias("direct_notes")).filter(F.col("direct_notes") >= at_least).orderBy(F.col("direct_notes").desc(), "folder").limit(limit)


def subject_clusters(notes: DataFrame, at_least: int = 5, limit: int = 6) -> DataFrame:
    """AGG-8 and SRT-10 for each folder: tags and title tokens that enough notes share while enough do not.
    Title tokens that are parts of tags are left out, as are terms that name the folder; notes(path, folder, title, tags)."""
    terms = F.concat(
        F.transform(F.array_distinct("tags"), lambda t: F.struct(F.lit("tag").alias("kind"), F.lower(t).alias("term"))),
        F.transform(F.array_except(title_tokens(F.col("title")), F.flatten(F.transform("tags", lambda t: F.split(F.lower(t), "[^a-z0-9]+")))), lambda t: F.struct(F.lit("title").alias("kind"), t.alias("term"))),
    )
    counted = notes.select("folder", F.explode(terms).alias("x")).groupBy("folder", "x.kind", "x.term").agg(F.count(F.lit(1)).alias("notes"))
    sizes = notes.groupBy("folder").agg(F.count(F.lit(1)).alias("size"))
    kept = counted.join(sizes, "folder").filter((F.col("notes") >= at_least) & (F.col("size") - F.col("notes") >= at_least) & (F.col("term") != F.lower("folder")))
    order = Window.partitionBy("folder").orderBy(F.col("notes").desc(), "kind", "term")
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("folder", "kind", "term", "notes", "place")


def _chains(terms: list[str]) -> list[str]:
    """The pairs of one component joined: from each pair that none leads to, in order, to the least pair not yet taken that
    goes on from it. Each pair is looked at once."""
    after: dict[str, list[str]] = {}
    for term in sorted(terms, reverse=True):
        after.setdefault(term[0], []).append(term)  # the least is last
    ends = {t[1] for t in terms}
    left, out = set(terms), []
    for head in sorted(t for t in terms if t[0] not in ends):
        chain, term = [head[0]], head
        while term is not None:
            left.discard(term)
            chain.append(term[1])
            rest = after.get(term[1], [])
            term = rest.pop() if rest else None
        out.append("".join(chain))
    return out + sorted(left)


def merge_pairs(counts: DataFrame) -> DataFrame:
    """AGG-9: pairs of characters with equal counts that overlap by one character join into longer terms; of counts(folder,
    term, notes) the terms of two characters are pairs, others stay. A term is a step from its first character to its second
    in the graph of one folder and count; only the steps of one component can follow each other, so components are found
    first, distributed, and each is walked through on its own, in time that grows with its pairs. These are bounded by the
    square of the alphabet, whatever the corpus."""
    from notelens.operators.graph import weak_components

    keys = ["folder", "notes"]
    with Scratch(counts.sparkSession, "pairs") as scratch:
        every = scratch.staged(counts.select(*keys, "term").distinct(), "terms")
        pairs = every.filter(F.length("term") == 2).select(*keys, "term", F.substring("term", 1, 1).alias("a"), F.substring("term", 2, 1).alias("b"))
        comps = weak_components(scratch, pairs, keys).withColumnRenamed("node", "a")

        def chain(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"folder": rows["folder"].iloc[0], "term": _chains(list(rows["term"])), "notes": rows["notes"].iloc[0]})

        merged = pairs.join(comps, [*keys, "a"]).groupBy(*keys, "comp").applyInPandas(chain, "folder string, term string, notes long")
        others = every.filter(F.length("term") != 2).select("folder", "term", F.col("notes").cast("long").alias("notes"))
        return staged(counts.sparkSession, merged.unionByName(others), "merged")


#: Bounds that are whole numbers may come out slightly above in floating point.
SLACK = 1e-6


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matcher's ratio; it depends on the order of its arguments."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


# not deterministic for the optimizer: it must not move a Python function into a join or an aggregation
sequence_ratio = sequence_ratio.asNondeterministic()


def similar_titles(titles: DataFrame, floor: float = 0.85) -> DataFrame:
    """JN-8: pairs of distinct titles at or above a ratio (over 2/3), but for those equal without digits.

    The ratio is 2 M / (la + lb), where M characters match in order. A pair of adjacent characters of one title is lost in
    the other only by one of the la - M characters left out (two pairs each) or of the lb - M put in (one each), so at least
    3 M - la - lb - 1 pairs are shared, counted as a multiset. Of a title's pairs so many of the rarest are keys that a
    partner must share one of them; titles that share a key are screened by length before the matcher runs. Titles of one
    or two characters have no partner.
    """
    if floor <= 2 / 3:
        raise ValueError("the bound on shared pairs needs a floor over 2/3")
    base = titles.select("title").distinct().withColumn("n", F.length("title")).filter("n > 2")
    grams = base.select("title", "n", F.explode(F.regexp_extract_all("title", F.lit("(?s)(?=(..))"), F.lit(1))).alias("gram")).groupBy("title", "n", "gram").count()
    each = grams.select("title", "n", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("i"), "gram").select("title", "n", F.concat("gram", F.lit("#"), F.col("i").cast("string")).alias("item"))
    frequency = each.groupBy("item").count()
    # a partner of length m has 2 M >= floor (n + m) and m >= M, so m >= floor n / (2 - floor)
    shared = (1.5 * floor - 1) * (F.col("n") + F.col("n") * floor / (2 - floor)) - 1
    need = F.greatest(F.ceil(shared - SLACK), F.lit(1))
    order = Window.partitionBy("title").orderBy("count", "item")
    prefix = each.join(frequency, "item").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("n") - need).select("title", "n", "item")
    a, b = prefix.select(F.col("title").alias("a"), F.col("n").alias("na"), "item"), prefix.select(F.col("title").alias("b"), F.col("n").alias("nb"), "item")
    pairs = a.join(b, "item").filter((F.col("a") < F.col("b")) & (2 * F.least("na", "nb") >= floor * (F.col("na") + F.col("nb")) - SLACK)).select("a", "b").distinct()
    bare = lambda c: F.regexp_replace(c, "[0-9]+", "")
    series = (bare("a") == bare("b")) & (bare("a") != "")
    return pairs.filter(~series).withColumn("ratio", F.greatest(sequence_ratio("a", "b"), F.lit(0.0))).filter(F.col("ratio") >= floor)


def pair_score(tags_a: Column, tags_b: Column, type_a: Column, type_b: Column, title_a: Column, title_b: Column) -> Column:
    """RNK-22: three for each shared tag, one for the same type, two for each shared title token, at most six."""
    shared = F.size(F.array_intersect(tags_a, tags_b))
    same = F.when(type_a.isNotNull() & (type_a == type_b), 1).otherwise(0)
    return 3 * shared + same + F.least(F.lit(6), 2 * F.size(F.array_intersect(title_tokens(title_a), title_tokens(title_b))))


def suggest_links(seed: DataFrame, candidates: DataFrame, related: DataFrame, generic: tuple[str, ...] = (), min_score: int = 3, limit: int = 10) -> DataFrame:
    """RNK-23 for one seed note: scores every candidate but those already related. Tags that two or more and at
    least half of the candidates carry are general. notes(path, title, type, tags); related(path)."""
    used = candidates.select("path", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").count()
    total = candidates.agg(F.count(F.lit(1)).alias("total"))
    common = used.crossJoin(total).filter("count >= 2 and count * 2 >= total").agg(F.collect_list("tag").alias("common"))  # at most two tags for each tag a note carries
    one = seed.limit(1).select(F.col("path").alias("seed"), F.col("title").alias("seed_title"), F.col("type").alias("seed_type"), F.col("tags").alias("seed_tags")).crossJoin(common)
    pairs = candidates.join(related, "path", "left_anti").crossJoin(F.broadcast(one)).filter("path <> seed")
    drop = F.concat("common", F.array(*map(F.lit, generic)).cast("array<string>"))
    score = pair_score(F.array_except("seed_tags", drop), F.col("tags"), F.col("seed_type"), F.col("type"), F.col("seed_title"), F.col("title"))
    return pairs.select("path", score.alias("score")).filter(F.col("score") >= min_score).orderBy(F.col("score").desc(), "path").limit(limit)


def scope_terms(title: Column, tags: Column) -> Column:
    """The tokens of a note's title and tags."""
    return F.array_distinct(F.concat(title_tokens(title), F.flatten(F.transform(F.coalesce(tags, F.array().cast("array<string>")), title_tokens))))


def candidate_folders(notes: DataFrame, folders: DataFrame, siblings: int = 2) -> DataFrame:
    """RNK-24: for each note(path, title, tags) the folders in which candidates are sought: its own, and the first
    siblings by path whose name shares a token with its title or tags; folders(folder). Folders meet notes by parent
    and token, so no note is held against all folders."""
    parent = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    placed = notes.select("path", parent(F.col("path")).alias("own"), scope_terms(F.col("title"), F.col("tags")).alias("terms")).withColumn("parent", F.when(F.col("own") == "", "").otherwise(parent(F.col("own"))))
    named = folders.select("folder", parent(F.col("folder")).alias("parent"), F.explode(title_tokens(F.element_at(F.split("folder", "/"), -1))).alias("token"))
    near = placed.select("path", "own", "parent", F.explode("terms").alias("token")).join(named, ["parent", "token"]).filter("folder <> own").select("path", "folder").distinct()
    order = Window.partitionBy("path").orderBy("folder")
    kept = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= siblings)
    return placed.select("path", F.col("own").alias("folder"), F.lit(0).alias("place")).unionByName(kept)


def vault_summary(notes: DataFrame, at_least: int = 20, limit: int = 20) -> DataFrame:
    """QRY-12: what a vault holds, one row for each fact: notes in all, by type, by crowded folder and by tag, each
    dimension in its own order and within its limit; notes(path, type, folder, tags)."""
    total = notes.agg(F.count(F.lit(1)).alias("notes")).select(F.lit("all").alias("facet"), F.lit("").alias("name"), "notes")
    types = notes.groupBy(F.coalesce("type", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("notes")).select(F.lit("type").alias("facet"), "name", "notes")
    folders = crowded_folders(notes, at_least, limit).select(F.lit("folder").alias("facet"), F.col("folder").alias("name"), F.col("direct_notes").alias("notes"))
    tags = tag_vocabulary(notes).select(F.lit("tag").alias("facet"), F.col("tag").alias("name"), "notes")
    return total.unionByName(types).unionByName(folders).unionByName(tags)
