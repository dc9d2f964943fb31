"""How far the sources of a language stand apart in their words, and which words mark each source.

Every source gives each of the V kept terms of its language a smoothed share p, and two shares differ by
f(p, q) = floor((p - q)^2 / (p + q)). A pair of sources is not compared term by term: it starts at V times f of two zero
counts, and postings of the inverted index correct that start where a count is not zero. A posting of g corrects every
pair of g as if the other source lacked the term; that depends on the term by its count alone, so postings of one count are
added up first. Where both sources hold the term, the two one-sided corrections are replaced by the pair's own f, so only
postings of one term ever meet. All of it is integers: counts in decimals where a product could pass 64 bits.

Defined cases: null texts, languages and sources count as ''; a text without letters has no terms; a group without kept
terms gives every term its smoothed zero; a language without kept terms has pairs of value 0 and no terms; a language of
one source has no pairs; equal values rank by the bytes of the item; repeated rows count as documents of their own; an
empty table gives no rows. Ids are not looked at, nor any other column.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelens.llm.workers import small_batches
from notelens.sources.tables import Scratch, staged

TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000


def terms_of(text: str) -> list[bytes]:
    """All runs of letters A to Z and of characters beyond ASCII, A to Z in lower case, as UTF-8."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and docs (documents that hold the term) of each batch."""
    for batch in batches:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = terms_of(text)
            if found:
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                n.update(found)
                docs.update(set(found))
        for (lang, source), (n, docs) in groups.items():
            terms, size = list(n), len(n)
            columns = [pa.repeat(lang, size), pa.repeat(source, size), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _share(count: str, total: str, kept: str) -> Column:
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(19, 0)) div greatest({total} + 2 * {kept}, 1L)")


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def index_terms(texts: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n (occurrences in the source) and lang_n (in the language) for each term that at least min_docs
    documents of its language hold. Terms are counted where the texts lie, a bounded batch at a time, before anything is
    shuffled."""
    rows = texts.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    counted = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    return counted.withColumns({"lang_n": F.sum("n").over(same), "lang_docs": F.sum("docs").over(same)}).filter(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n")


def _groups(texts: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, total, kept (V), lang_total and p0, the share of a zero count, for each group that occurs."""
    kept = postings.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    return found.withColumn("p0", _share("0", "total", "kept"))


def _pairs(scratch: Scratch, postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language."""
    mine = groups.select("lang", "source", "kept", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    start = mine.join(other, "lang").filter("source <> item")
    alike = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    one_sided = alike.join(start, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.expr(f"sum(terms * ({_apart('p', 'q0')} - {_apart('p0', 'q0')}))").alias("fix"))
    held = postings.select("lang", "term", "source", "p", "p0")
    met = held.join(held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0")), ["lang", "term"]).filter("source < item")
    more = F.expr(f"{_apart('p', 'q')} - {_apart('p', 'q0')} - {_apart('p0', 'q')} + {_apart('p0', 'q0')}")
    both = scratch.staged(met.select("lang", "source", "item", more.alias("fix")).filter("fix <> 0").groupBy("lang", "source", "item").agg(F.sum("fix").alias("fix")), "both")
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "fix")
    base = start.selectExpr("lang", "source", "item", f"kept * {_apart('p0', 'q0')} AS fix")
    parts = base.unionByName(one_sided).unionByName(turned(one_sided)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", "source", "item").agg(F.sum("fix").alias("value"))


def source_divergence(spark: SparkSession, docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language ("pair"), and the terms ("term", ranks to
    top) that the source uses more than its language, by value."""
    small_batches(spark)
    with Scratch(spark, "divergence") as scratch:
        texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
        index = scratch.staged(index_terms(texts, min_docs), "index")
        groups = scratch.staged(_groups(texts, index), "groups")
        shares = {"p": _share("n", "total", "kept"), "q": _share("lang_n", "lang_total", "kept")}
        postings = scratch.staged(index.join(groups, ["lang", "source"]).withColumns(shares).select("lang", "source", "term", "p", "q", "p0"), "postings")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = _pairs(scratch, postings, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
        marks = postings.filter("p > q").selectExpr("lang", "source", "'term' AS part", "term AS item", f"{_apart('p', 'q')} AS value")
        terms = marks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return staged(spark, pairs.unionByName(terms), "divergence")
