"""Folders and their index notes (SRC-22, JN-15, MSC-12; the folder-index codes of the audit).

A folder is linked into the graph of its vault by an index note that its parent looks for under a certain name. Folders are
all prefixes of the paths of files, so what stands above a folder is found by equality on prefixes, without recursion.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelens.sources.vault import index_excluded

# The plugin that makes index notes, its files, and the folder of archived sources, which has none.
PLUGIN = "obsidian-folder-index"
ENABLED_FILE, SETTINGS_FILE = ".obsidian/community-plugins.json", f".obsidian/plugins/{PLUGIN}/data.json"
ARCHIVE = "95-Sources"
SEVERITY = {
    "missing-folder-index": "hygiene", "misnamed-folder-index": "hygiene", "graph-incompatible-index-config": "defect", "broken-folder-graph-chain": "defect", "duplicate-folder-index": "defect",
    "missing-folder-index-content": "hygiene", "duplicate-folder-index-content": "defect",
}


@dataclass(frozen=True)
class IndexConfig:
    enabled: bool = False
    graph_overwrite: bool = False
    root_index_file: str = "INDEX.md"
    user_specified: bool = False
    index_filename: str = "INDEX"
    exclude_folders: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()


def _loaded(text: str | None, kind: type) -> Any:
    try:
        value = json.loads(text or "")
    except ValueError:
        return kind()
    return value if isinstance(value, kind) else kind()


def index_config(enabled: str | None, settings: str | None) -> IndexConfig:
    """SRC-22: the configuration in two JSON texts; defaults where the plugin is off or a text cannot be read."""
    if PLUGIN not in _loaded(enabled, list):
        return IndexConfig()
    got = _loaded(settings, dict)
    names = lambda key: tuple(str(x) for x in got.get(key, []) if str(x)) if isinstance(got.get(key, []), list) else ()
    return IndexConfig(
        True, bool(got.get("graphOverwrite", False)), str(got.get("rootIndexFile", "INDEX.md")), bool(got.get("indexFileUserSpecified", False)), str(got.get("indexFilename", "INDEX")),
        tuple(x.strip("/") for x in names("excludeFolders")), names("excludePatterns"),
    )


def load_config(files: DataFrame) -> IndexConfig:
    """SRC-22 from files(path, text) of a vault."""
    found = {r.path: r.text for r in files.filter(F.col("path").isin(ENABLED_FILE, SETTINGS_FILE)).select("path", "text").collect()}
    return index_config(found.get(ENABLED_FILE), found.get(SETTINGS_FILE))


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _prefixes(folder: Column) -> Column:
    """A folder and all above it but the root, from the top down."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def folders_of(files: DataFrame, config: IndexConfig) -> DataFrame:
    """folder of each folder that needs an index: it holds a file, or a folder that does, and nothing exempts it."""
    every = files.select(_folder(F.col("path")).alias("f")).filter("f <> ''").distinct().select(F.explode(_prefixes(F.col("f"))).alias("folder")).distinct()
    hidden = F.exists(F.split("folder", "/"), lambda p: p.startswith("."))
    archived = F.split_part("folder", F.lit("/"), F.lit(1)) == ARCHIVE
    return every.filter(~hidden & ~archived & ~index_excluded(F.col("folder"), config.exclude_folders, config.exclude_patterns))


def _own_name(folder: Column) -> Column:
    return F.concat(F.element_at(F.split(folder, "/"), -1), F.lit(".md"))


def expected_index(folder: Column, config: IndexConfig) -> Column:
    """MSC-12: the file name of the index of a folder below the root."""
    return F.lit(f"{config.index_filename}.md") if config.user_specified else _own_name(folder)


def _states(files: DataFrame, config: IndexConfig) -> DataFrame:
    """folder, expected (a path), present (it is there) and linked (the note that the parent looks for is there)."""
    folders = folders_of(files, config).withColumns({"expected": F.concat("folder", F.lit("/"), expected_index(F.col("folder"), config)), "target": F.concat("folder", F.lit("/"), _own_name(F.col("folder")))})
    there = files.select("path").distinct().withColumn("there", F.lit(True))
    held = folders.join(there.withColumnsRenamed({"path": "expected", "there": "present"}), "expected", "left").join(there.withColumnsRenamed({"path": "target", "there": "linked"}), "target", "left")
    return held.select("folder", "expected", "target", F.coalesce("present", F.lit(False)).alias("present"), F.coalesce("linked", F.lit(False)).alias("linked"))


def index_findings(files: DataFrame, config: IndexConfig) -> DataFrame:
    """path, code and severity for the folder indexes of files(path, declares: whether the note says it is an index). Where
    the plugin is off, folders need none."""
    if not config.enabled:
        return files.select("path", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("severity")).limit(0)
    states = _states(files, config)
    missing = states.filter("NOT present").select(F.col("folder").alias("path"), F.lit("missing-folder-index").alias("code"))
    root = files.agg(F.coalesce(F.bool_or(F.col("path") == config.root_index_file), F.lit(False)).alias("root")).filter("NOT root").select(F.lit(".").alias("path"), F.lit("missing-folder-index").alias("code"))
    declared = files.filter("declares").select("path", _folder(F.col("path")).alias("folder"))
    misnamed = declared.join(states, "folder").filter("path <> expected").select("path", F.lit("misnamed-folder-index").alias("code"))
    found = missing.unionByName(root).unionByName(misnamed)
    if config.graph_overwrite:
        found = found.unionByName(states.filter("present AND expected <> target").select(F.col("expected").alias("path"), F.lit("broken-folder-graph-chain").alias("code")))
        if config.user_specified:
            some = states.limit(1).select(F.lit(SETTINGS_FILE).alias("path"), F.lit("graph-incompatible-index-config").alias("code"))
            found = found.unionByName(some)
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return found.withColumn("severity", severity[F.col("code")])


def graph_reach(files: DataFrame, config: IndexConfig) -> DataFrame:
    """folder, depth, broken_at and reached: whether the graph leads from the root to each folder. It leads on from a folder
    to those below through the note of the folder's own name; broken_at is the uppermost folder without one, itself
    included. Exempt folders break nothing."""
    states = _states(files, config)
    steps = states.select("folder", F.explode(_prefixes(F.col("folder"))).alias("above"))
    held = steps.join(states.select(F.col("folder").alias("above"), "linked"), "above", "left")
    depth = F.size(F.split("above", "/"))
    first = F.min(F.when(~F.coalesce("linked", F.lit(True)), F.struct(depth.alias("depth"), F.col("above").alias("folder"))))
    broken = held.groupBy("folder").agg(F.max(depth).alias("depth"), first.alias("b"))
    return broken.select("folder", "depth", F.col("b.folder").alias("broken_at"), F.col("b").isNull().alias("reached"))


# Fixed value: the first word of a line that opens the block that the plugin fills.
CONTENT_MARK = "```folder-index-content"


def content_findings(notes: DataFrame) -> DataFrame:
    """path, code, severity: index notes(path, type, body) without the block of their content, or with several."""
    blocks = F.size(F.filter(F.split("body", "\r\n|[\r\n]", -1), lambda ln: F.regexp_extract(ln, r"^\s*(\S+)", 1) == CONTENT_MARK))
    code = F.when(blocks == 0, "missing-folder-index-content").when(blocks > 1, "duplicate-folder-index-content")
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return notes.filter("type = 'folder-index'").select("path", code.alias("code")).filter("code IS NOT NULL").withColumn("severity", severity[F.col("code")])
