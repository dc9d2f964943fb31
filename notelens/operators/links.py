"""Link graph (JN, TXT and QRY rows of the inventory): links(source, line, name, origin) and
keys(key, priority, path), where a smaller priority wins. Priority 0 is a whole path, for names with a slash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelens.functions.text import link_target

STRUCTURAL_TYPES = ("moc", "index", "folder-index")


def link_keys(notes: DataFrame) -> DataFrame:
    """Keys of notes (path, stem, aliases): path 0, file name 1, stem 2, alias 3."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    named = notes.select("path", F.explode(F.array(F.struct(F.lower("path").alias("key"), F.lit(0).alias("priority")), F.struct(name.alias("key"), F.lit(1).alias("priority")), F.struct(F.regexp_replace(name, r"\.md$", "").alias("key"), F.lit(2).alias("priority")))).alias("k"))
    aliased = notes.select("path", F.explode("aliases").alias("a")).select("path", F.struct(F.lower("a").alias("key"), F.lit(3).alias("priority")).alias("k"))
    return named.unionByName(aliased).select("k.key", "k.priority", "path").distinct()


def _state(joined: DataFrame, columns: list[str]) -> DataFrame:
    n = F.coalesce("n_targets", F.lit(0))
    return joined.select(
        *columns, F.when(n == 0, "unresolved").when(n > 1, "ambiguous").otherwise("resolved").alias("state"),
        F.when(n == 1, F.col("only")).alias("target"), n.cast("long").alias("n_targets"),
    )


def resolve_names(links: DataFrame, keys: DataFrame) -> DataFrame:
    """JN-3 and JN-5: adds state (resolved, ambiguous, unresolved), target (where resolved) and n_targets.
    Of the kinds of key that match a name only the first counts."""
    distinct = keys.select("key", "priority", "path").distinct()
    ranked = distinct.groupBy("key", "priority").agg(F.count(F.lit(1)).alias("n_targets"), F.min("path").alias("only"))
    best = ranked.groupBy("key").agg(F.min(F.struct("priority", "n_targets", "only")).alias("b")).select("key", "b.n_targets", "b.only")
    return _state(links.join(best.withColumnRenamed("key", "name"), "name", "left"), links.columns)


def _plain(path: Column) -> Column:
    """A path without empty and . parts and with .. applied; null where it leaves the vault."""
    up = F.lit("..")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda done, p: F.when(p != up, F.concat(done, F.array(p))).when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def path_candidates(name: Column, source: Column) -> Column:
    """JN-4: the paths a name with a slash may mean, from the vault and from its source's folder, as it stands and,
    without a suffix, with .md. A name from the root of the file system means none."""
    folder = F.regexp_extract(F.lower(source.cast("string")), "^(.*/)[^/]*$", 1)
    both = F.array(name, F.concat(folder, name))
    bare = ~F.regexp_replace(name, "/+$", "").rlike(r"[^/]\.[^./]+$")
    every = F.when(bare, F.concat(both, F.transform(both, lambda p: F.concat(p, F.lit(".md"))))).otherwise(both)
    return F.when(name.startswith("/"), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.transform(every, _plain))))


def resolve(links: DataFrame, keys: DataFrame) -> DataFrame:
    """JN-3 to JN-5: as resolve_names, but a name with a slash is a path and meets only keys of whole paths."""
    slash = F.coalesce(F.contains("name", F.lit("/")), F.lit(False))
    named = resolve_names(links.filter(~slash), keys.filter("priority > 0"))
    paths = links.filter(slash)
    asked = paths.select("source", "name").distinct().withColumn("key", F.explode(path_candidates(F.col("name"), F.col("source"))))
    held = asked.join(keys.filter("priority = 0").select("key", "path").distinct(), "key").groupBy("source", "name").agg(F.count_distinct("path").alias("n_targets"), F.min("path").alias("only"))
    return named.unionByName(_state(paths.join(held, ["source", "name"], "left"), links.columns))


def undated_matches(links: DataFrame, notes: DataFrame) -> DataFrame:
    """JN-6: unresolved names that a note has behind a date: source, name, dated path. A diagnosis only."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""))
    dated = notes.select("path", stem.alias("stem")).filter(r"stem rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2} '").select("path", F.substring("stem", 12, 1 << 20).alias("name"))
    return links.filter("state = 'unresolved'").join(dated, "name").select("source", "name", "path")


def neighbourhood(resolved: DataFrame, seed, direction: str = "both", max_nodes: int = 20) -> DataFrame:
    """QRY-8, JN-7, AGG-14: neighbours of one note with directions and origins; SRT-7 order, at most max_nodes."""
    known = resolved.filter("state = 'resolved' and source <> target")
    out = known.filter(F.col("source") == seed).select(F.col("target").alias("neighbour"), F.lit("out").alias("direction"), "origin")
    back = known.filter(F.col("target") == seed).select(F.col("source").alias("neighbour"), F.lit("in").alias("direction"), "origin")
    edges = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    grouped = edges.groupBy("neighbour").agg(F.array_sort(F.collect_set("direction")).alias("directions"), F.array_sort(F.collect_set("origin")).alias("origins"), F.count(F.lit(1)).alias("edges"))
    return grouped.orderBy("neighbour").limit(max_nodes)


def neighbourhood_edges(resolved: DataFrame, seed, direction: str = "both", max_nodes: int = 20) -> DataFrame:
    """QRY-8: the edges behind ``neighbourhood``: neighbour (null where a name of the seed resolves to none or to several),
    name, direction, origin, line, state. Edges to neighbours beyond the bound are left out, unresolved ones never; order:
    resolved first, then by neighbour or name, direction, origin, line."""
    out = resolved.filter((F.col("source") == seed) & ~F.coalesce(F.col("target") == seed, F.lit(False)))
    out = out.select(F.when(F.col("state") == "resolved", F.col("target")).alias("neighbour"), "name", F.lit("out").alias("direction"), "origin", "line", "state")
    back = resolved.filter((F.col("target") == seed) & (F.col("state") == "resolved") & (F.col("source") != seed)).select(F.col("source").alias("neighbour"), "name", F.lit("in").alias("direction"), "origin", "line", "state")
    edges = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    kept = neighbourhood(resolved, seed, direction, max_nodes).select("neighbour")
    named = edges.filter("neighbour IS NOT NULL").join(F.broadcast(kept), "neighbour", "left_semi")  # max_nodes rows at most
    shown = F.coalesce(F.col("neighbour").cast("string"), "name")
    return named.unionByName(edges.filter("neighbour IS NULL").select(*named.columns)).orderBy(F.col("neighbour").isNull(), shown, "direction", "origin", F.coalesce("line", F.lit(-1)))


def degrees(resolved: DataFrame) -> DataFrame:
    """Distinct neighbours of each note: path, n_out, n_in, and both."""
    known = resolved.filter("state = 'resolved' and source <> target").select("source", "target").distinct()
    sides = known.select(F.col("source").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(known.select("target", F.lit(0), F.lit(1)))
    return sides.groupBy("path").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def orphans(notes: DataFrame, resolved: DataFrame, indexed: DataFrame) -> DataFrame:
    """JN-9: notes that nothing refers to and no index covers."""
    referred = resolved.filter("state = 'resolved' and source <> target").select(F.col("target").alias("path"))
    return notes.join(referred, "path", "left_anti").join(indexed, "path", "left_anti")


def disconnected(notes: DataFrame, resolved: DataFrame, indexed: DataFrame) -> DataFrame:
    """JN-10: indexed notes without links in or out."""
    known = resolved.filter("state = 'resolved' and source <> target")
    ends = known.select(F.col("source").alias("path")).unionAll(known.select("target"))
    return notes.join(indexed, "path", "left_semi").join(ends, "path", "left_anti")


# Phrases that say one note depends on another.
DEPENDENCY_MARKERS = (
    "cites", "citing", "引用自", "引自", "names", "naming", "点名", "delegates", "delegated", "委托给", "交由", "traced to", "traces to", "追溯到", "溯源自", "in response to", "响应于", "因应",
    "expressed as", "measured in", "基于", "以…为基准", "references", "referencing", "参照", "参考自", "for its", "as its", "作为其", "用作", "selected from", "选自", "取自", "consumes", "consuming", "消费自",
    "imports", "importing", "沿用", "继承自", "branches on", "依据", "proven with", "proven by", "verified by", "由…证明", "据以验证", "follows", "following", "遵循", "fails when", "当…时失败", "前置知识", "前序知识",
)
#: A sentence ends after a CJK terminator, after a Latin one before white space, and at a line feed.
SENTENCE_END = r"(?<=[。！？])|(?<=[.!?])(?=\s)|\n"


def dependency_markers(text: Column, markers: tuple[str, ...] = DEPENDENCY_MARKERS) -> Column:
    """TXT-20: the markers that a text holds, in the order of the table."""
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(text), F.lower(m)))


def sentence_at(text: Column, position: Column) -> Column:
    """TXT-19: the sentence of a text that covers a position (from 0), trimmed."""
    parts = F.split(text, SENTENCE_END, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("found"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        after = end + F.when(F.substr(text, end + 1, F.lit(1)) == "\n", 1).otherwise(0)  # a line feed goes with the sentence it ends
        covers = (acc["at"] <= position) & ((position < after) | (position >= F.length(text)))
        return F.struct(after.alias("at"), F.when(covers, part).otherwise(acc["found"]).alias("found"))

    return F.trim(F.aggregate(parts, start, step)["found"])


def related_names(related: Column) -> Column:
    """TXT-18: the names a related list holds, each a wiki link or bare: link marks, label, heading and extension off."""
    inner = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"\[\[([^\[\]]+)\]\]", 1), F.lit("")), x)
    names = F.transform(F.coalesce(related, F.array().cast("array<string>")), lambda x: F.lower(link_target(inner(F.trim(x)))))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def directed_dependencies(links: DataFrame, markers: tuple[str, ...] = DEPENDENCY_MARKERS) -> DataFrame:
    """RNK-25: links(source, target, line, sentence, type, state) whose sentence holds a dependency marker; for each
    target the first line, in order of line and target, with the first marker of the table. Rows stay where they lie
    but for one sum."""
    held = links.filter(F.col("state") == "resolved").filter(~F.coalesce(F.col("type").isin(*STRUCTURAL_TYPES), F.lit(False)))
    hit = held.withColumn("marker", F.try_element_at(dependency_markers(F.col("sentence"), markers), F.lit(1))).filter("marker is not null")
    return hit.groupBy("source", "target").agg(F.min(F.struct("line", "marker")).alias("m")).select("source", "target", "m.line", "m.marker").orderBy("source", "line", "target")
