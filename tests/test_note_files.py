"""Heads of notes: what is read, where reading stops, and files written by tasks."""

from __future__ import annotations

import io
import pathlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from notelens.functions.markdown import parse_meta
from notelens.sources import note_files

META = "---\ntype: guide\ndate: 2024-05-06\n---\n"
FILES = {
    "a/long.md": META + "x" * 100_000, "a/crlf.md": META.replace("\n", "\r\n") + "body", "b/none.md": "# no block\n" + "y" * 50_000, "b/bom.MD": "﻿" + META + "z" * 9000,
    "c/open.md": "---\ntype: guide\n" + "k: v\n" * 60_000, "c/empty.md": "", "c/at the edge.md": "---\ntype: '" + "q" * (8192 - 15) + "'\n---\nrest" + "r" * 20_000, "c/ünï.md": "---\ntype: guide\n---",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('notes')}/v"
    note_files.write_notes(spark.createDataFrame(list(FILES.items()), "path string, text string").repartition(3), root)
    return root


def test_files_are_written_whole_and_nothing_else(folder):
    root = pathlib.Path(folder.removeprefix("file://"))
    assert {str(p.relative_to(root)): p.read_bytes().decode() for p in root.rglob("*") if p.is_file()} == FILES


def test_heads_stop_at_the_closing_line(spark, folder):
    got = {r.path: r for r in note_files.read_heads(spark, folder).collect()}
    assert set(got) == set(FILES)
    read = {p: r.bytes_read for p, r in got.items()}
    assert read["a/long.md"] == read["b/none.md"] == read["b/bom.MD"] == 8192 and read["c/at the edge.md"] == 2 * 8192
    assert read["c/open.md"] == note_files.LIMIT < got["c/open.md"].size and read["c/empty.md"] == 0
    assert sum(read.values()) < sum(r.size for r in got.values())


def test_metadata_of_heads_is_that_of_whole_files(spark, folder):
    rows = note_files.head_metadata(note_files.read_heads(spark, folder)).collect()
    for r in rows:
        has, meta, issue, *_ = parse_meta(FILES[r.path])
        assert (r.has_meta, r.issue, r.meta is not None) == (has, issue, meta is not None), r.path


def test_a_prefix_leaves_other_files_closed(spark, folder):
    assert {r.path for r in note_files.read_heads(spark, folder, prefix="a/").collect()} == {"a/long.md", "a/crlf.md"}


def test_writing_again_changes_nothing_and_other_notes_are_kept(spark, folder):
    note_files.write_notes(spark.createDataFrame([("c/empty.md", "")], "path string, text string"), folder)
    for path, text in (("c/empty.md", "other"), ("../out.md", "x"), ("a//b.md", "x"), ("/abs.md", "x")):
        with pytest.raises(Exception, match="another note|not a path"):
            note_files.write_notes(spark.createDataFrame([(path, text)], "path string, text string"), folder)
    note_files.write_notes(spark.createDataFrame([("c/new.md", "n")], "path string, text string"), folder, overwrite=True)
    assert note_files.read_heads(spark, folder).filter("path = 'c/new.md'").first().head == "n"
    pathlib.Path(folder.removeprefix("file://"), "c/new.md").unlink()


def test_an_empty_folder(spark, tmp_path):
    assert note_files.read_heads(spark, f"file://{tmp_path}/none").isEmpty()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["---", "\n", "\r\n", "a: b", "é", "#", "--", " "]), max_size=40).map("".join), st.integers(1, 9), st.integers(1, 60))
def test_head_is_a_start_of_the_text_and_has_the_whole_block(text, chunk, limit):
    head, taken = note_files.read_head(io.BytesIO(text.encode()), limit, chunk)
    assert text.startswith(head) and taken <= min(limit, len(text.encode()))
    if limit >= len(text.encode()):
        assert parse_meta(head)[:3] == parse_meta(text)[:3]
