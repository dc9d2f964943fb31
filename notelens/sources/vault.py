"""Notes as files: scans (SRC rows of the inventory). Each scan has its own rule of what it leaves out."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.functions.markdown import notes_of

MAX_BYTES = 2 * 1024 * 1024
# Folders that hold no notes, for each scan.
SEARCH_IGNORED = ("Attachments", "Templates", "95-Sources", "__pycache__", "node_modules")
AUDIT_IGNORED = (".git", ".obsidian", ".venv", ".workbuddy")
CAPTURE_IGNORED = (".obsidian", ".trash", ".git", "Templates")  # and the folder of backups


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files below root with path (relative), folder_parts, name, stem, size, mtime and text; a file over
    the size limit has no text and an issue instead."""
    root = root.rstrip("/")
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(root)
    # the reader takes a length as a filter, so the content of a file over the limit is never asked for
    large = every.filter(F.col("length") > MAX_BYTES).select("path", "length", "modificationTime", F.lit(None).cast("binary").alias("content"))
    files = every.filter(F.col("length") <= MAX_BYTES).select("path", "length", "modificationTime", "content").unionByName(large)
    bare = root.split("://", 1)[-1].rstrip("/") if "://" in root else root.removeprefix("file:").rstrip("/")
    at = F.instr("path", F.lit(bare)) + len(bare) + 1
    parts = F.split("p", "/")
    out = files.withColumn("p", F.substr("path", at))
    return out.select(
        F.col("p").alias("path"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folder_parts"), F.element_at(parts, -1).alias("name"), F.regexp_replace(F.element_at(parts, -1), r"(?i)\.md$", "").alias("stem"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("text"), F.when(F.col("length") > MAX_BYTES, "note-too-large").alias("file_issue"),
    )


def _hidden(part: Column) -> Column:
    return part.startswith(".")


def search_scan(files: DataFrame) -> DataFrame:
    """SRC-1, SRC-2."""
    return files.filter(~F.exists("folder_parts", lambda p: _hidden(p) | p.isin(*SEARCH_IGNORED)))


def audit_scan(files: DataFrame) -> DataFrame:
    """SRC-10."""
    inside = F.array_join("folder_parts", "/")
    return files.filter(~F.exists("folder_parts", lambda p: _hidden(p) | p.isin(*AUDIT_IGNORED)) & ~inside.startswith("docs/superpowers"))


def loop_scan(files: DataFrame) -> DataFrame:
    """SRC-12: also leaves out files with a hidden name."""
    return search_scan(files).filter(~_hidden(F.col("name")))


def capture_scan(files: DataFrame, backups: str = ".notelens-backups") -> DataFrame:
    """SRC-13. ``backups`` is the folder that holds copies made before a write; nobody reopens those."""
    return files.filter(~F.exists("folder_parts", lambda p: p.isin(*CAPTURE_IGNORED, backups)))


def linkable_scan(files: DataFrame, exempt: tuple[str, ...] = ("README.md", "AGENTS.md", "CLAUDE.md")) -> DataFrame:
    """SRC-14."""
    return files.filter(~F.exists("folder_parts", _hidden) & ~_hidden(F.col("name")) & ~F.col("name").isin(*exempt))


def inbox_scan(files: DataFrame, inbox: str = "00-Inbox") -> DataFrame:
    """SRC-15: direct children only."""
    return files.filter(F.col("folder_parts") == F.array(F.lit(inbox)))


def load_notes(files: DataFrame, max_issues: int = 20) -> tuple[DataFrame, DataFrame]:
    """SRC-3: (notes that can be read, issues); what cannot be read is a row of issues, never an error."""
    parsed = notes_of(files.filter("file_issue is null"))
    bad = parsed.filter("issue is not null").select("path", F.col("issue").alias("code"), F.col("issue_line").alias("line"))
    large = files.filter("file_issue is not null").select("path", F.col("file_issue").alias("code"), F.lit(None).cast("int").alias("line"))
    return parsed.filter("issue is null"), bad.unionByName(large).orderBy("path").limit(max_issues)


def scan_counts(files: DataFrame, notes: DataFrame) -> DataFrame:
    """AGG-3: files, indexed, skipped."""
    return files.agg(F.count(F.lit(1)).alias("files")).crossJoin(notes.agg(F.count(F.lit(1)).alias("indexed"))).withColumn("skipped", F.col("files") - F.col("indexed"))


def scope_stats(files: DataFrame) -> DataFrame:
    """SRC-25: notes by top folder."""
    return search_scan(files).groupBy(F.coalesce(F.get("folder_parts", F.lit(0)), F.lit(".")).alias("folder")).agg(F.count(F.lit(1)).alias("notes"))


def _glob(pattern: str) -> str:
    """A shell pattern as an expression over a whole name; a star crosses folders."""
    return "^" + fnmatch.translate(pattern).removesuffix(r"\Z").removesuffix(r"\z") + r"\z"


def index_excluded(folder: Column, folders: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """FLT-11: whether a folder needs no index: it is or lies in one of these folders, or it or its name fits a pattern."""
    name = F.element_at(F.split(folder, "/"), -1)
    out = F.lit(False)
    for f in folders:
        out = out | (folder == f) | folder.startswith(f + "/")
    for p in patterns:
        out = out | folder.rlike(_glob(p)) | name.rlike(_glob(p))
    return out


# Stems that some systems keep for devices, and signs that no portable name has.
RESERVED_STEMS = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
INVALID_SIGNS = r'[\x00-\x1f<>:"/\\|?*]'


def portable_name(name: Column) -> Column:
    """FLT-16: whether a name can be that of a visible folder on every system."""
    bad = (name == "") | (name != F.trim(name)) | name.startswith(".") | name.endswith(".") | F.upper(F.split_part(name, F.lit("."), F.lit(1))).isin(*RESERVED_STEMS) | (F.octet_length(name) > 255) | name.rlike(INVALID_SIGNS)
    return ~F.coalesce(bad, F.lit(True))


def inside(path: Column) -> Column:
    """FLT-4, FLT-5: whether a path relative to the vault stays below it: not absolute, and no step leaves it."""
    parts = F.filter(F.split(path, "[/\\\\]"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.lit(0), lambda d, p: F.when(d < 0, d).when(p == "..", d - 1).otherwise(d + 1))
    return F.coalesce(~path.rlike(r"^([/\\\\]|[A-Za-z]:)") & (depth > 0), F.lit(False))


def attachments(spark: SparkSession, root: str) -> DataFrame:
    """SRC-11: files that are no notes, by path, size and time; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/")).select("path", "length", "modificationTime")
    return files.filter(~F.lower("path").endswith(".md")).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
