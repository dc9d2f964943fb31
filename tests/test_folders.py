"""Folder indexes: configuration, names, the chain of the graph, blocks of content."""

from __future__ import annotations

import json

import pytest
from notelens.operators import folders
from notelens.operators.folders import IndexConfig

ON = json.dumps(["x", folders.PLUGIN])


def test_configuration():
    assert folders.index_config(None, "{}") == folders.index_config('["other"]', '{"graphOverwrite": true}') == folders.index_config("{", None) == IndexConfig()
    assert folders.index_config(ON, "[1]") == folders.index_config(ON, "no json") == IndexConfig(enabled=True)
    text = json.dumps({"graphOverwrite": True, "rootIndexFile": "Home.md", "indexFileUserSpecified": 1, "indexFilename": "00", "excludeFolders": ["/a/", "", 3], "excludePatterns": "no list"})
    assert folders.index_config(ON, text) == IndexConfig(True, True, "Home.md", True, "00", ("a", "3"), ())


FILES = ["INDEX.md", "a/a.md", "a/n.md", "a/b/n.md", "a/b/c/c.md", "a/b/c/INDEX.md", "d/INDEX.md", "d/e/e.md", "skip/x/n.md", ".git/n.md", "95-Sources/s/n.md"]


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[-1] == "INDEX.md" or p.split("/")[-1][:-3] in p.split("/")[:-1]) for p in FILES], "path string, declares boolean").repartition(3)


def codes(df):
    return sorted((r.path, r.code) for r in df.collect())


def test_findings_under_own_names(files):
    config = IndexConfig(enabled=True, graph_overwrite=True, exclude_folders=("skip",))
    assert codes(folders.index_findings(files, config)) == [("a/b", "missing-folder-index"), ("a/b/c/INDEX.md", "misnamed-folder-index"), ("d", "missing-folder-index"), ("d/INDEX.md", "misnamed-folder-index")]


def test_findings_under_one_name(files):
    config = IndexConfig(enabled=True, graph_overwrite=True, user_specified=True, root_index_file="Home.md", exclude_folders=("skip",))
    got = codes(folders.index_findings(files, config))
    assert [p for p, c in got if c == "broken-folder-graph-chain"] == ["a/b/c/INDEX.md", "d/INDEX.md"]
    assert (folders.SETTINGS_FILE, "graph-incompatible-index-config") in got and (".", "missing-folder-index") in got
    assert [p for p, c in got if c == "missing-folder-index"] == [".", "a", "a/b", "d/e"]
    assert folders.index_findings(files, IndexConfig()).isEmpty()


def test_reach(files):
    got = {r.folder: (r.depth, r.broken_at, r.reached) for r in folders.graph_reach(files, IndexConfig(enabled=True, exclude_folders=("skip",))).collect()}
    assert got == {"a": (1, None, True), "a/b": (2, "a/b", False), "a/b/c": (3, "a/b", False), "d": (1, "d", False), "d/e": (2, "d", False)}


def test_content_blocks(spark):
    block = "```folder-index-content\n```\n"
    rows = [("one", "folder-index", "# t\n" + block), ("none", "folder-index", "```folder-index-contents\n```"), ("two", "folder-index", block + "  " + block.replace("content\n", "content x\n", 1)), ("other", "log", ""), ("empty", "folder-index", "")]
    got = codes(folders.content_findings(spark.createDataFrame(rows, "path string, type string, body string")))
    assert got == [("empty", "missing-folder-index-content"), ("none", "missing-folder-index-content"), ("two", "duplicate-folder-index-content")]


def test_configuration_of_a_vault(spark):
    rows = [(folders.ENABLED_FILE, ON), (folders.SETTINGS_FILE, '{"indexFilename": "00"}'), ("n.md", "x")]
    assert folders.load_config(spark.createDataFrame(rows, "path string, text string")).index_filename == "00"
