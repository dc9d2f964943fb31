"""Ranked search over notes (RNK, FLT and SRT rows of the inventory).

A query is known on the driver, so each note is scored where it lies: term counts of its names and of
each section come from array functions, corpus statistics from one aggregation of a single row, and
only the best k rows are shuffled. Texts never are. Names alone go to Python, for the name boost.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelens.functions.markdown import cut_sections
from notelens.functions.text import CJK, normal_name, tag_key, tokenize
from notelens.sources.tables import staged

K1, B = 1.5, 0.75
FIELD_WEIGHTS = {"title": 6.0, "aliases": 5.0, "tags": 3.0, "headings": 2.0, "links": 2.0}
EXPANDED_WEIGHT, CONFIDENCE_FLOOR, EXACT_BOOST, FUZZY_BOOST, FUZZY_FLOOR = 0.45, 0.30, 12.0, 4.0, 0.72
MAX_CONCEPTS, MAX_EXPANDED, MAX_SNIPPET = 8, 24, 480


def query_tokens(query: str) -> list[str]:
    """The tokens of a query, in order; as TXT-1."""
    out: list[str] = []
    for run in re.findall(f"[A-Za-z0-9]+|[{CJK}]+", query):
        if run[0].isascii():
            out.append(run.lower())
        else:
            out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
    return out


@dataclass(frozen=True)
class Filters:
    """FLT-1: dimensions all hold, values of one are alternatives."""

    types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    after: str | None = None
    before: str | None = None
    updated_after: str | None = None
    updated_before: str | None = None

    def reject_reason(self) -> Column:
        """The first dimension that rejects a note, or null."""
        rules: list[tuple[str, Column]] = []
        if self.types:
            rules.append(("type", ~F.coalesce(F.col("type").isin(*self.types), F.lit(False))))
        if self.tags:
            wanted = F.array(*[tag_key(F.lit(t)) for t in self.tags])
            rules.append(("tag", ~F.arrays_overlap(F.transform("tags", tag_key), wanted)))
        for name, low, high, words in (("date", self.after, self.before, ("after", "before")), ("updated", self.updated_after, self.updated_before, ("updated-after", "updated-before"))):
            if low or high:
                rules.append((f"missing-{name}", F.col(name).isNull()))
            if low:
                rules.append((words[0], F.col(name) < F.lit(low).cast("date")))
            if high:
                rules.append((words[1], F.col(name) > F.lit(high).cast("date")))
        reason = F.lit(None).cast("string")
        for name, rule in reversed(rules):
            reason = F.when(rule, name).otherwise(reason)
        return reason

    def applied(self) -> dict[str, tuple[str, ...] | str]:
        """FLT-2: the dimensions that hold, as a result echoes them."""
        return {name: value for name, value in vars(self).items() if value}

    def select(self, notes: DataFrame) -> DataFrame:
        return notes.filter(self.reject_reason().isNull())

    def tally(self, notes: DataFrame) -> DataFrame:
        """AGG-2: reason, excluded; the counts sum to the notes that were dropped."""
        return notes.select(self.reject_reason().alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("excluded"))


@dataclass(frozen=True)
class Concept:
    id: str
    terms: tuple[str, ...]


def expand_query(query: str, concepts: Iterable[Concept]) -> tuple[list[str], list[tuple[str, str, list[str]]], bool]:
    """RNK-18: (added tokens, concepts used with the matched term and what each adds, whether cut short)."""
    typed = query_tokens(query)

    def offset(term: str) -> int | None:
        if re.search(f"[{CJK}]", term):
            at = query.casefold().find(term.casefold())
            return at if at >= 0 else None
        needle = query_tokens(term)
        return next((i for i in range(len(typed) - len(needle) + 1) if needle and typed[i : i + len(needle)] == needle), None)

    found = []
    for concept in concepts:
        at = min(((o, n) for n, t in enumerate(concept.terms) if (o := offset(t)) is not None), default=None)
        added = list(dict.fromkeys(t for term in concept.terms for t in query_tokens(term) if t not in typed))
        if at is not None and added:
            found.append((at[0], concept.id, concept.terms[at[1]], added))
    tokens: list[str] = []
    used = []
    for _, name, term, added in sorted(found):
        if len(used) == MAX_CONCEPTS:
            return tokens, used, True
        fresh = [t for t in added if t not in tokens]
        room = MAX_EXPANDED - len(tokens)
        tokens += fresh[:room]
        if fresh[:room]:
            used.append((name, term, fresh[:room]))
        if len(fresh) > room:
            return tokens, used, True
    return tokens, used, False


def _count(tokens: Column, token: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == token))


def idf(df: Column, n: Column) -> Column:
    """RNK-3."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def profile(notes: DataFrame, tokens: list[str], sections: bool = True) -> DataFrame:
    """Adds name_tf (weighted counts of each token in the names), name_length, and passages: (no, tf, length)
    of each section with tokens. Sections stand between visible headings where the notes have ``lines``; where not, each
    line is one, and without ``sections`` the whole body."""
    fields = [(f, w) for f, w in FIELD_WEIGHTS.items() if f in notes.columns]
    as_text = lambda f: F.array_join(f, "\n") if dict(notes.dtypes)[f].startswith("array") else F.col(f)
    named = notes.select("*", *[tokenize(as_text(f)).alias(f"_{f}") for f, _ in fields])
    total = lambda of: sum((w * of(F.col(f"_{f}")) for f, w in fields), F.lit(0.0))
    if sections and "lines" in notes.columns:
        parts = F.transform(cut_sections(F.col("lines")), lambda s: s["text"])
    else:
        parts = F.split("body", "\n", -1) if sections else F.array("body")
    cut = F.transform(parts, lambda p, i: F.struct(i.alias("no"), tokenize(p).alias("t")))
    cut = F.filter(cut, lambda p: F.size(p["t"]) > 0)
    # what the query asks for is picked out first, so that its tokens are counted among a few
    cut = F.transform(cut, lambda p: F.struct(p["no"].alias("no"), F.filter(p["t"], lambda t: t.isin(*tokens)).alias("t"), F.size(p["t"]).alias("length")))
    cut = F.transform(cut, lambda p: F.struct(p["no"].alias("no"), F.array(*[_count(p["t"], t) for t in tokens]).alias("tf"), p["length"].alias("length")))
    out = named.select(*notes.columns, F.array(*[total(lambda c, t=t: _count(c, t)) for t in tokens]).alias("name_tf"), total(F.size).alias("name_length"), cut.alias("passages"))
    mean = F.when(F.size("passages") > 0, F.aggregate("passages", F.lit(0).cast("long"), lambda s, p: s + p["length"]) / F.size("passages")).otherwise(F.lit(0.0))
    # once the lengths are known, sections without a hit matter only to notes whose names have one
    some = F.exists("name_tf", lambda x: x > 0)
    held = F.when(some, F.col("passages")).otherwise(F.filter("passages", lambda p: F.exists(p["tf"], lambda x: x > 0)))
    return out.withColumn("mean_length", mean).withColumn("passages", held)


def statistics(profiled: DataFrame, tokens: list[str]) -> DataFrame:
    """RNK-6 and RNK-7, one row: n, average_length, df of each token; names and the whole body count."""
    has = lambda i: (F.col("name_tf")[i] > 0) | F.exists("passages", lambda p: p["tf"][i] > 0)
    return profiled.agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.avg(F.col("name_length") + F.col("mean_length")), F.lit(1.0)).alias("average_length"),
        F.array(*[F.count_if(has(i)) for i in range(len(tokens))]).alias("df"),
    )


def scored(ready: DataFrame, weights: dict[str, float]) -> DataFrame:
    """RNK-2 for rows with name_tf, name_length, mean_length, passages and the statistics n, df and average_length: adds
    score and passage_no of the best section."""
    def score(p: Column) -> Column:
        length = F.col("name_length") + F.greatest(p["length"].cast("double"), F.col("mean_length"))
        norm = K1 * (1 - B + B * length / F.col("average_length"))
        out = F.lit(0.0)
        for i, (_, weight) in enumerate(weights.items()):
            f = F.col("name_tf")[i] + p["tf"][i]
            out = out + weight * idf(F.col("df")[i].cast("double"), F.col("n").cast("double")) * (f * (K1 + 1) / (f + norm))
        return F.struct(out.alias("score"), (-p["no"]).alias("minus"))

    empty = F.array(F.struct(F.lit(0).alias("no"), F.array(*[F.lit(0)] * len(weights)).alias("tf"), F.lit(0).alias("length")))
    best = F.array_max(F.transform(F.when(F.size("passages") > 0, F.col("passages")).otherwise(empty), score))
    rated = ready.withColumn("_best", best).withColumns({"score": F.col("_best.score"), "passage_no": -F.col("_best.minus")})
    return rated.drop("_best", "average_length")


def bm25(notes: DataFrame, weights: dict[str, float], sections: bool = True) -> DataFrame:
    """RNK-2: adds score (of the best section), passage_no (its place; the earliest on ties), df, n, and drops
    scores of 0. ``weights`` is 1 for typed tokens and less for expanded ones. Texts are read once: the counts they give
    are written to the shared folder, where notes without a hit take a few numbers. The body is not in the result."""
    tokens = list(weights)
    profiled = staged(notes.sparkSession, profile(notes, tokens, sections).drop("body", "lines"), "search-profile")
    return scored(profiled.crossJoin(F.broadcast(statistics(profiled, tokens))), weights)  # one row


def name_boost(query: str, title: Column) -> Column:
    """RNK-8, exact arm."""
    return F.when(normal_name(title) == " ".join(query_tokens(query)), F.lit(EXACT_BOOST)).otherwise(F.lit(0.0))


def name_boosts(notes: DataFrame, query: str, normal: str | None = None) -> DataFrame | None:
    """RNK-8: path and boost of the notes that get one, by both arms over title and aliases, or over the array of normal
    names that ``normal`` calls. Names go to the matcher alone, and only those whose length lets them reach the floor."""
    wanted = " ".join(query_tokens(query))
    parts = [F.array("title")] if "title" in notes.columns else []
    parts += [F.coalesce("aliases", F.array().cast("array<string>"))] if "aliases" in notes.columns else []
    if not wanted or not (parts or normal):
        return None
    names = F.col(normal) if normal else F.transform(F.flatten(F.array(*parts)), normal_name)
    # 2 min(a, b) / (a + b) >= 0.72, in integers
    near = F.filter(names, lambda n: 50 * F.least(F.length(n), F.lit(len(wanted))) >= round(25 * FUZZY_FLOOR) * (F.length(n) + len(wanted)))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boosts = [_boost(wanted, ns) for ns in batch.column("near").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(boosts, pa.float64())], ["path", "boost"])

    asked = notes.select("path", near.alias("near")).filter(F.size("near") > 0)
    return asked.mapInArrow(rated, f"path {dict(notes.dtypes)['path']}, boost double").filter("boost > 0")


def _boost(wanted: str, names: list[str]) -> float:
    if wanted in names:
        return EXACT_BOOST
    ratio = max(SequenceMatcher(None, wanted, n).ratio() for n in names)
    return FUZZY_BOOST * ratio if ratio >= FUZZY_FLOOR else 0.0


def with_name_boost(notes: DataFrame, query: str, normal: str | None = None) -> DataFrame:
    """Adds boost (0 for most); paths are distinct."""
    boosts = name_boosts(notes, query, normal)
    if boosts is None:
        return notes.withColumn("boost", F.lit(0.0))
    return notes.join(boosts, "path", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))


def ranked(notes: DataFrame, query: str, added: Iterable[str] = (), sections: bool = True) -> DataFrame:
    """RNK-1: bm25 of the typed and the added tokens, with the name boost of the raw query (boost) in the score."""
    weights = dict.fromkeys(query_tokens(query), 1.0)
    scored = bm25(with_name_boost(notes, query), weights | {t: EXPANDED_WEIGHT for t in added if t not in weights}, sections)
    return scored.withColumn("score", F.col("score") + F.col("boost"))


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """RNK-10 and SRT-1: positive scores, best first, then by path; without a shuffle of what is beaten."""
    return scored.filter(F.col(score) > 0).orderBy(F.col(score).desc(), F.lower(F.col("path").cast("string")), "path").limit(k)


def with_bodies(top_notes: DataFrame, notes: DataFrame) -> DataFrame:
    """The rows of a result with their bodies, in the same order; a result has a bounded number of rows."""
    held = [c for c in ("body", "lines", "body_start_line") if c in notes.columns and c not in top_notes.columns]
    joined = notes.select("path", *held).join(F.broadcast(top_notes), "path")
    return joined.orderBy(F.col("score").desc(), F.lower(F.col("path").cast("string")), "path")


def snippet(top_notes: DataFrame, tokens: list[str]) -> DataFrame:
    """RNK-14 for the few rows of a result: adds line (1-based, of the file where body_start_line is known), heading, hits
    and snippet. Notes with ``lines`` are cut at their headings; others at line feeds, where a line without a hit is no
    snippet."""
    if "lines" in top_notes.columns:
        section = F.get(cut_sections(F.col("lines")), F.col("passage_no"))
        found = section_snippet(top_notes.withColumns({"_from": section["start_line"], "_to": section["end_line"]}), tokens, "lines", "_from", "_to").drop("_from", "_to")
        return found.withColumn("line", F.col("line") + F.col("body_start_line") - 1) if "body_start_line" in found.columns else found
    lines = F.array(F.struct(F.get(F.split("body", "\n", -1), F.col("passage_no")).alias("text"), F.lit(0).alias("heading_level"), F.lit(None).cast("string").alias("heading")))
    found = section_snippet(top_notes.withColumns({"_lines": lines, "_from": F.lit(0), "_to": F.lit(1)}), tokens, "_lines", "_from", "_to")
    return found.drop("_lines", "_from", "_to", "heading").withColumns({"line": F.col("passage_no") + 1, "snippet": F.when(F.col("hits") > 0, F.col("snippet")).otherwise(F.lit(""))})


def section_snippet(top_notes: DataFrame, tokens: list[str], lines: str = "lines", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """RNK-14 for the few rows of a result with their lines (text, heading_level, heading) and the winning section from
    ``start`` (0-based) to before ``end``: adds line (1-based), heading, hits and snippet. The best line holds most
    distinct tokens, each up to three times; a heading only if no other line does, then the earliest; without a hit it
    is the first line with text. The window is the line and its neighbours inside the section, without headings."""
    section = F.slice(lines, F.col(start) + 1, F.greatest(F.col(end) - F.col(start), F.lit(0)))
    blank = lambda ln: F.trim(F.regexp_replace(ln["text"], r"\s+", " ")) == ""

    def rated(ln: Column, i: Column) -> Column:
        found = tokenize(ln["text"])
        hits = sum((F.least(_count(found, t), F.lit(3)) for t in dict.fromkeys(tokens)), F.lit(0))
        # a line without a hit comes after all with one, and only a visible one counts
        order = F.when(hits > 0, F.struct(F.lit(0).alias("a"), (-hits).alias("b"), (ln["heading_level"] > 0).cast("int").alias("c"), i.alias("at"))).when(~blank(ln) & (ln["heading_level"] == 0), F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), i.alias("at")))
        return order

    rows = top_notes.withColumn("_section", section).withColumn("_best", F.array_min(F.array_compact(F.transform("_section", rated))))
    near = F.filter("_section", lambda ln, i: (F.abs(i - F.col("_best.at")) <= 1) & (ln["heading_level"] == 0) & ~blank(ln))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(near, lambda ln: F.trim(ln["text"])), " "), r"\s+", " "))
    short = F.when(F.length(text) > MAX_SNIPPET, F.concat(F.rtrim(F.substring(text, 1, MAX_SNIPPET - 1)), F.lit("…"))).otherwise(text)
    under = F.filter(F.slice(lines, F.lit(1), F.col(start) + F.col("_best.at") + 1), lambda ln: ln["heading_level"] > 0)
    added = {"line": F.col(start) + F.col("_best.at") + 1, "hits": F.coalesce(-F.col("_best.b"), F.lit(0)), "heading": F.try_element_at(under, F.lit(-1))["heading"], "snippet": F.coalesce(short, F.lit(""))}
    return rows.withColumns(added).drop("_section", "_best")


#: Where words of a query can stand in a note, and what a result calls it.
MATCH_FIELDS = {"title": "title", "aliases": "alias", "tags": "tag", "headings": "heading", "links": "link", "body": "body"}
MAX_DETAIL = 160


def _field_tokens(found: DataFrame, tokens: list[str]) -> dict[str, Column]:
    """The tokens that each field of a result of ``bm25`` over them holds; of the body the winning section counts."""
    section = F.try_element_at(F.filter("passages", lambda p: p["no"] == F.col("passage_no")), F.lit(1))["tf"]
    wanted = F.array(*map(F.lit, tokens)).cast("array<string>")
    out = {}
    for field in MATCH_FIELDS:
        if field == "body":
            out[field] = F.coalesce(F.filter(wanted, lambda t, i: F.get(section, i) > 0), F.array().cast("array<string>"))
        elif field in found.columns:
            text = F.array_join(field, "\n") if dict(found.dtypes)[field].startswith("array") else F.col(field)
            out[field] = F.array_intersect(wanted, tokenize(text))
    return out


def matched_words(found: DataFrame, tokens: list[str], typed: list[str]) -> DataFrame:
    """RNK-11 and RNK-12 for rows of ``bm25`` over ``tokens``: adds matched (field, words: which typed ones it holds,
    sorted) and signals (kind, detail: them in one text)."""
    asked = F.array(*map(F.lit, dict.fromkeys(typed))).cast("array<string>")
    each = [F.struct(F.lit(field).alias("field"), F.array_sort(F.array_intersect(held, asked)).alias("words")) for field, held in _field_tokens(found, tokens).items()]
    matched = F.filter(F.array(*each), lambda m: F.size(m["words"]) > 0)
    names = F.create_map(*[F.lit(x) for pair in MATCH_FIELDS.items() for x in pair])
    signals = F.transform("matched", lambda m: F.struct(F.element_at(names, m["field"]).alias("kind"), F.substring(F.array_join(m["words"], ", "), 1, MAX_DETAIL).alias("detail")))
    return found.withColumn("matched", matched).withColumn("signals", signals)


def expansion_signals(found: DataFrame, tokens: list[str], used: list[tuple[str, str, list[str]]]) -> DataFrame:
    """RNK-13: adds expansion (kind, detail) for each concept of ``expand_query`` of which a note's names or its winning
    section hold an added token."""
    held = F.array_distinct(F.flatten(F.array(*_field_tokens(found, tokens).values())))
    each = []
    for _, term, added in used:
        hits = F.array_intersect(F.array(*map(F.lit, added)), held)
        each.append(F.when(F.size(hits) > 0, F.struct(F.lit("expansion").alias("kind"), F.substring(F.concat(F.lit(f"{term} → "), F.array_join(hits, ", ")), 1, MAX_DETAIL).alias("detail"))))
    return found.withColumn("expansion", F.array_compact(F.array(*each)) if each else F.array().cast("array<struct<kind:string,detail:string>>"))


def search(notes: DataFrame, query: str, k: int = 5, filters: Filters | None = None, scope: str | None = None, concepts: Iterable[Concept] = ()) -> DataFrame:
    """RNK-1: the best k notes (path, title, aliases, tags, body) for a query, with score, passage_no, matched, signals,
    expansion and snippet. Scope (a folder, by path) and filters hold before statistics are taken."""
    if scope not in (None, "", "."):
        notes = notes.filter(F.col("path").startswith(scope.rstrip("/") + "/"))
    kept = (filters or Filters()).select(notes)
    added, used, _ = expand_query(query, concepts)
    typed = list(dict.fromkeys(query_tokens(query)))
    tokens = typed + [t for t in added if t not in typed]
    if not tokens:
        raise ValueError("the query has no token")
    best = with_bodies(top(ranked(kept, query, added), k), kept)
    return expansion_signals(matched_words(snippet(best, tokens), tokens, typed), tokens, used)


def confidence(winner: DataFrame, typed: list[str]) -> DataFrame:
    """RNK-15 and RNK-16 for the best row of bm25 over the typed tokens: coverage, unseen and level."""
    n = F.col("n").cast("double")
    weight = [idf(F.col("df")[i].cast("double"), n) for i in range(len(typed))]
    section = F.element_at(F.filter("passages", lambda p: p["no"] == F.col("passage_no")), 1)
    held = [F.when((F.col("name_tf")[i] > 0) | F.coalesce(section["tf"][i] > 0, F.lit(False)), w).otherwise(0.0) for i, w in enumerate(weight)]
    coverage = sum(held, F.lit(0.0)) / sum(weight, F.lit(0.0))
    unseen = F.array_sort(F.array_compact(F.array(*[F.when(F.col("df")[i] == 0, F.lit(t)) if re.fullmatch(r"[a-z0-9]{3,}", t) and not t.isdigit() else F.lit(None).cast("string") for i, t in enumerate(typed)])))
    level = F.when((coverage >= CONFIDENCE_FLOOR) & (F.size(unseen) == 0), "evidence").otherwise("none")
    return winner.select("path", F.round(coverage, 3).alias("coverage"), F.array_join(unseen, ",").alias("unseen"), level.alias("level"))


def zero_reason(candidates: Column, matched: Column, skipped: Column) -> Column:
    """RNK-17."""
    return (
        F.when((matched == 0) & (candidates > 0), "all-candidates-filtered").when((candidates == 0) & (skipped > 0), "material-files-skipped")
        .when(candidates == 0, "no-searchable-documents").otherwise("no-token-overlap")
    )
