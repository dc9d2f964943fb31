"""Resume packs, templates, folder indexes and new notes (QRY-9 to QRY-13, QRY-21 to QRY-29, JN-15, MSC rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelens.functions.text import safe_filename


def resume_fields(sections: DataFrame, vocabulary: dict[str, tuple[str, ...]]) -> DataFrame:
    """QRY-10: sections(path, section, from, text) as fields: of a field's headings the first in the note that has text."""
    rows = [(f, h.strip().lower()) for f, hs in vocabulary.items() for h in hs]
    known = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(h).alias("key")) for f, h in rows]))
    matched = sections.withColumn("k", known).filter(F.lower(F.trim("section")) == F.col("k.key"))
    return matched.groupBy("path", F.col("k.field").alias("field")).agg(F.min(F.struct("from", "text")).alias("m")).select("path", "field", "m.text", F.col("m.from").alias("line"))


def heading_report(lines: DataFrame, vocabulary: dict[str, tuple[str, ...]]) -> DataFrame:
    """QRY-11: headings of each note that the vocabulary knows and does not, in order."""
    known = [h.strip().lower() for hs in vocabulary.values() for h in hs]
    heads = lines.filter("heading_level > 0").withColumn("known", F.lower(F.trim("heading")).isin(*known))
    gathered = heads.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "heading", "known"))).alias("h"))
    pick = lambda known_: F.transform(F.filter("h", lambda x: x["known"] == known_), lambda x: x["heading"])
    return gathered.select("path", pick(F.lit(True)).alias("matched"), pick(F.lit(False)).alias("unmatched"))


def missing_and_contested(fields: DataFrame, paths: DataFrame, members: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """SET-6 and QRY-9: for each project the wanted fields that neither it nor a source answers, and those that both
    do. members(project, path) are its sources."""
    own = fields.groupBy("path").agg(F.collect_set("field").alias("own")).withColumnRenamed("path", "project")
    theirs = members.join(fields, "path").groupBy("project").agg(F.collect_set("field").alias("theirs"))
    none = F.array().cast("array<string>")
    joined = paths.withColumnRenamed("path", "project").join(own, "project", "left").join(theirs, "project", "left")
    joined = joined.withColumns({"own": F.coalesce("own", none), "theirs": F.coalesce("theirs", none)})
    want = F.array(*map(F.lit, wanted))
    return joined.select("project", F.array_except(F.array_except(want, "own"), "theirs").alias("missing"), F.array_sort(F.array_intersect("own", "theirs")).alias("contested"))


def project_members(notes: DataFrame, projects: DataFrame, related: DataFrame) -> DataFrame:
    """JN-12 and SET-1: notes of a project by folder, by their project field, and by a related link that names it;
    a name that several projects have is ambiguous and joins nobody. notes(path, folder, project, date),
    projects(project, name, folder), related(path, name)."""
    names = projects.groupBy(F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("project").alias("project")).filter("n = 1").drop("n")
    inside = notes.drop("project").join(projects.select("project", "folder"), "folder").filter("path <> project").select("project", "path", "date", F.lit(0).alias("trust"), F.lit("location").alias("origin"))
    field = notes.withColumn("key", F.lower("project")).drop("project").join(names, "key").select("project", "path", "date", F.lit(1).alias("trust"), F.lit("project-field").alias("origin"))
    link = related.withColumn("key", F.lower("name")).join(names, "key").join(notes.select("path", "date"), "path").select("project", "path", "date", F.lit(2).alias("trust"), F.lit("related-link").alias("origin"))
    every = inside.unionByName(field).unionByName(link).groupBy("project", "path").agg(F.min("trust").alias("trust"), F.max("date").alias("date"), F.array_sort(F.collect_set("origin")).alias("origins"))
    order = Window.partitionBy("project").orderBy("trust", F.col("date").desc_nulls_last(), "path")
    return every.withColumn("place", F.row_number().over(order))


def resume_pack(projects: DataFrame, fields: DataFrame, members: DataFrame, wanted: tuple[str, ...], max_sources: int = 5) -> DataFrame:
    """QRY-9: one row for each of projects(project), whose own note has the project as its path: resume (field to text, of
    its own note), from_sources (field to what the sources say, in their order), contested (fields that both answer),
    missing (wanted fields that its own note lacks), sources (the first max_sources of project_members, in order of trust,
    newest first), sources_available and truncated. fields(path, field, text) as of resume_fields. Nothing is gathered
    beyond the bound: at most max_sources entries, and as many for each field."""
    order = ("place", "path")
    bounded = members.filter(F.col("place") <= max_sources).select("project", "path", "place", "origins", "date")
    own = fields.join(projects.select(F.col("project").alias("path")), "path", "left_semi").groupBy(F.col("path").alias("project")).agg(F.array_sort(F.collect_list(F.struct("field", "text"))).alias("own"))
    said = bounded.join(fields, "path").groupBy("project", "field").agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("said"))
    said = said.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("field", F.transform("said", lambda x: F.struct(x["path"].alias("path"), x["text"].alias("text"))).alias("said")))).alias("theirs"))
    listed = bounded.groupBy("project").agg(F.array_sort(F.collect_list(F.struct(*order, "origins", "date"))).alias("sources"))
    counted = members.groupBy("project").agg(F.count("*").alias("sources_available"))
    rows = projects.select("project").distinct()
    for part in (own, said, listed, counted):
        rows = rows.join(part, "project", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    names = lambda c: F.transform(c, lambda x: x["field"])
    kinds = dict(rows.dtypes)
    rows = rows.withColumns({c: empty(F.col(c), kinds[c]) for c in ("own", "theirs", "sources")}).withColumn("sources_available", F.coalesce("sources_available", F.lit(0)))
    return rows.select(
        "project", F.map_from_entries("own").alias("resume"), F.map_from_entries("theirs").alias("from_sources"), F.array_intersect(names(F.col("own")), names(F.col("theirs"))).alias("contested"),
        F.array_except(F.array(*map(F.lit, wanted)), names(F.col("own"))).alias("missing"), F.transform("sources", lambda x: F.struct(x["path"].alias("path"), x["origins"].alias("origins"), x["date"].alias("date"))).alias("sources"),
        "sources_available", (F.col("sources_available") > F.size("sources")).alias("truncated"),
    )


def folder_indexes(folders: DataFrame, files: DataFrame, mode: str = "folder-name") -> DataFrame:
    """JN-15, MSC-12, JN-17: folders(folder) without their expected index (folder name or INDEX.md), with one under the other
    name, or with both: missing-folder-index, misnamed-folder-index, duplicate-folder-index. files(path, folder, name, declares)."""
    own = F.concat(F.element_at(F.split("folder", "/"), -1), F.lit(".md"))
    expected, other = (own, F.lit("INDEX.md")) if mode == "folder-name" else (F.lit("INDEX.md"), own)
    named = files.filter("declares").withColumns({"is_expected": F.col("name") == expected, "is_other": F.col("name") == other})
    state = named.groupBy("folder").agg(F.bool_or("is_expected").alias("e"), F.bool_or("is_other").alias("o"))
    code = F.when(F.col("e") & F.col("o"), "duplicate-folder-index").when(F.coalesce("e", F.lit(False)), F.lit(None)).when(F.coalesce("o", F.lit(False)), "misnamed-folder-index").otherwise("missing-folder-index")
    return folders.join(state, "folder", "left").select("folder", code.alias("code")).filter("code is not null")


def heading_repairs(note: DataFrame, template: DataFrame) -> DataFrame:
    """TXT-33: headings of a note that a template has at another level: path, line, heading, level, wanted.
    note(path, line, heading, heading_level), template(heading, heading_level)."""
    wanted = template.groupBy("heading").agg(F.min("heading_level").alias("wanted"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return note.join(wanted, "heading").filter("heading_level <> wanted").select("path", "line", "heading", F.col("heading_level").alias("level"), "wanted")


def customised_templates(templates: DataFrame, starters: DataFrame) -> DataFrame:
    """AGG-15, QRY-28: templates(name, content) whose digest is no starter's."""
    return templates.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).join(starters.select("sha256"), "sha256", "left_anti").select("name", "sha256")


def scaffold(desired: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """SNK-7: template files to write; those that exist stay unless forced."""
    return desired if force else desired.join(existing.select("path"), "path", "left_anti")


def merged_metadata(defaults: Column, template: Column, given: Column, explicit: Column) -> Column:
    """QRY-21: maps of strings, the later one wins."""
    out = defaults
    for later in (template, given, explicit):
        out = F.map_concat(_without(out, later), later)
    return out


def _without(base: Column, later: Column) -> Column:
    return F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(later), k))


def render_template(body: Column, title: Column, date: Column) -> Column:
    """MSC-10: placeholders filled, and the first first-level heading bound to the title."""
    filled = F.replace(F.replace(body, F.lit("{{title}}"), title), F.lit("{{date}}"), date)
    at = F.regexp_instr(filled, F.lit("(?m)^# .*$"))
    rest = F.regexp_replace(F.substr(filled, F.greatest(at, F.lit(1))), "^# [^\n]*", "")
    return F.when(at > 0, F.concat(F.substr(filled, F.lit(1), at - 1), F.lit("# "), title, rest)).otherwise(filled)


def unique_names(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """SNK-2, QRY-24: file names for wanted(folder, title, at): the plain name, then -2, -3 and so on after those that
    existing(folder, name) has. Names of one folder only meet each other."""
    made = wanted.withColumn("stem", safe_filename(F.col("title")))
    taken = existing.withColumn("stem", F.regexp_replace(F.regexp_replace("name", r"\.md$", ""), r"-[0-9]+$", "")).groupBy("folder", "stem").agg(F.count(F.lit(1)).alias("taken"))
    order = Window.partitionBy("folder", "stem").orderBy("at", "title")
    n = F.row_number().over(order) + F.coalesce("taken", F.lit(0))
    return made.join(taken, ["folder", "stem"], "left").withColumn("n", n).select("folder", "title", F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(F.lit("")), F.lit(".md")).alias("name"))


def archive_stem(title: Column, date: Column) -> Column:
    """MSC-2: a dated stem of at most 80 characters before the archive mark."""
    dated = F.when(title.rlike(r"^\d{4}-\d{2}-\d{2}"), title).otherwise(F.concat(date, F.lit(" "), title))
    return F.concat(F.rtrim(F.substring(safe_filename(dated), 1, 80)), F.lit("·原文"))


def archive(notes: DataFrame) -> DataFrame:
    """SNK-4, MSC-4: notes(path, source, content) as archive text that binds the verbatim content by digest, and back."""
    digest = F.sha2("content", 256)
    return notes.select("path", F.concat(F.lit("---\ntype: source-archive\nsource: "), "source", F.lit("\nsha256: "), digest, F.lit("\n---\n"), "content").alias("text"), digest.alias("sha256"))


def archived_content(text: Column) -> Column:
    return F.substr(text, F.instr(text, F.lit("\n---\n")) + 5)


def git_path(quoted: Column) -> Column:
    """SRC-18: a path that the log quotes: octal escapes are bytes of its UTF-8 form, letters after a backslash signs. Plain
    paths come back as they are; bytes that are no text are replaced."""
    inner = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    tokens = F.regexp_extract_all(inner, F.lit(r"(?s)(\\[0-7]{3}|\\.|[^\\]+)"), F.lit(1))
    signs = F.create_map(*[F.lit(x) for sign, code in zip("abtnvfr", range(7, 14), strict=True) for x in (sign, f"{code:02X}")])

    def bytes_of(t: Column) -> Column:
        octal = F.lpad(F.conv(F.substr(t, F.lit(2)), 8, 16), 2, "0")
        named = F.coalesce(signs[F.substr(t, F.lit(2))], F.hex(F.encode(F.substr(t, F.lit(2)), "UTF-8")))
        return F.when(t.rlike(r"^\\[0-7]{3}$"), F.right(octal, F.lit(2))).when(t.startswith("\\"), named).otherwise(F.hex(F.encode(t, "UTF-8")))

    whole = (F.length(quoted) >= 2) & quoted.startswith('"') & quoted.endswith('"')
    return F.when(whole, F.make_valid_utf8(F.unhex(F.array_join(F.transform(tokens, bytes_of), "")).cast("string"))).otherwise(quoted)


def first_refusal(rules: list[tuple[str, Column]]) -> Column:
    """QRY-22: the code of the first rule that refuses, or null."""
    out = F.lit(None).cast("string")
    for code, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), code).otherwise(out)
    return out


def extend_list(base: Column, more: Column) -> Column:
    """SET-8: without repeats, in order."""
    return F.array_distinct(F.concat(base, more))


def index_mode(files: DataFrame) -> DataFrame:
    """QRY-13: folder-index if its plugin is configured, dataview if an index uses it, else static. files(path, text)."""
    plugin = F.bool_or(F.col("path").contains("folder-index") & F.col("path").endswith("data.json"))
    view = F.bool_or(F.col("path").endswith("INDEX.md") & F.contains("text", F.lit("```dataview")))
    return files.agg(F.when(F.coalesce(plugin, F.lit(False)), "folder-index").when(F.coalesce(view, F.lit(False)), "dataview").otherwise("static").alias("mode"))
