"""The driver's tables in the roles of notes, links, tasks and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.functions.markdown import notes_of
from notelens.operators import postings
from notelens.sources.tables import Scratch, shared_dir, state_of, table

AS_OF = "2001-08-01"
_INDEXES: dict[tuple, postings.NoteIndex] = {}


def _index(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame, parsed: bool = False) -> postings.NoteIndex:
    """The posting table of notes made from a table: built once for a session and a state of the table's files. Notes that
    are parsed are written first, so that they are parsed once."""
    key = (spark.sparkContext.applicationId, sf_dir, name, state_of(spark, f"{sf_dir}/{name}.parquet"))
    if key not in _INDEXES:
        with Scratch(spark, "parsed") as scratch:
            _INDEXES[key] = postings.build(scratch.staged(rows, "notes") if parsed else rows, shared_dir(spark, f"index-{name}"))
    return _INDEXES[key]


def note_index(spark: SparkSession, sf_dir: str) -> postings.NoteIndex:
    """The index of documents as notes."""
    return _index(spark, sf_dir, "documents", notes(spark, sf_dir))


def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as Markdown files: a metadata block, a title, and a section for each turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    kind = F.when(F.exists("t", lambda t: t["role"] == "system"), "guided").otherwise("open")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 300).cast("int")), "yyyy-MM-dd")
    head = F.concat(F.lit("---\ntype: "), kind, F.lit("\ndate: "), day, F.lit("\ntags: [chat, turns-"), F.size("t").cast("string"), F.lit("]\n---\n# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"))
    parts = F.transform("t", lambda t: F.concat(F.lit("## "), t["role"], F.lit(" "), t["turn"].cast("string"), F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(F.concat(F.lit("chats/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.col("conv_id").cast("string").alias("stem"), F.concat(head, F.array_join(parts, "")).alias("text"))


def chat_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown files of conversations, parsed; headings is a field of the search."""
    parsed = notes_of(chat_files(spark, sf_dir))
    return parsed.withColumn("headings", F.transform(F.filter("lines", lambda ln: ln["heading_level"] > 0), lambda ln: ln["heading"]))


#: Types that documents as files have by language; es has none, de one that no vault knows.
FILE_TYPES = {"en": "guide", "fr": "web-clip", "de": "unheard"}


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as Markdown files that break rules now and then, by number: without or with an unclosed metadata block, date,
    tags or fence, with a placeholder left, web clips without a source, author or day."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    every = lambda n: F.col("doc_id") % n == 0
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\n"))
    kind = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])[F.col("lang")]
    tags = F.when(every(29), F.lit("[]")).when(every(31), F.lit("[a, b, c, d, e, f]")).when(every(37), F.lit("[Bad Tag]")).otherwise(F.concat(F.lit("["), "source", F.lit(", x]")))
    clip = F.concat(
        line("source", F.when(every(7), F.lit("unknown source")).otherwise(F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")))), line("author", F.when(every(11), F.lit("TBD")).otherwise("Ann")),
        F.when(every(13), F.lit("")).otherwise("published: 2024-01-02\n"), F.when(every(47), F.lit("capture_depth: deep\n")).otherwise(""),
    )
    block = F.concat(F.lit("---\n"), F.coalesce(line("type", kind), F.lit("")), F.when(every(17), F.lit("")).otherwise("date: 2024-03-04\n"), line("tags", tags), F.when(F.col("lang") == "fr", clip).otherwise(""), F.when(every(23), F.lit("")).otherwise("---\n"))
    title = F.coalesce(F.nullif(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))), F.lit("")), F.lit("Untitled"))
    body = F.concat(F.lit("# "), title, F.lit("\n\n"), "text", F.when(every(43), F.lit("\n{{date}}")).otherwise(""), F.when(every(41), F.lit("\n```\ncode")).otherwise(""), F.lit("\n"))
    return docs.select(F.col("doc_id").alias("path"), F.col("doc_id").cast("string").alias("stem"), F.concat(F.when(every(19), F.lit("")).otherwise(block), body).alias("text"))


def chat_index(spark: SparkSession, sf_dir: str) -> postings.NoteIndex:
    held = ("path", "title", "aliases", "tags", "headings", "type", "date", "updated", "lines")
    return _index(spark, sf_dir, "conversations", chat_notes(spark, sf_dir).select(*held), parsed=True)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: the first line is the title, lines are sections, language and source are tags."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("path"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.array("lang", "source").alias("tags"),
        F.col("lang").alias("type"), F.col("text").alias("body"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with their labels; most have none."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), "quality", "toxic")
    return notes(spark, sf_dir).join(labels, "path", "left")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as project notes: P is blocked, F closed; every 17th has no date."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "blocked").when(F.col("o_orderstatus") == "F", "closed").otherwise("active")
    return orders.select(
        F.col("o_orderkey").alias("path"), status.alias("status"),
        F.when(F.col("o_orderkey") % 17 != 0, F.to_date("o_orderdate")).alias("updated"), F.lit(None).cast("date").alias("date"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as tasks: open while O, and under a next-actions heading when not returned."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"),
        (F.col("l_linestatus") != "O").alias("checked"), (F.col("l_returnflag") == "N").alias("in_next_actions"), F.to_date("l_shipdate").alias("touched"),
    )
