"""Logs, folder rules, headings and payloads, by hand-worked cases."""

from __future__ import annotations

import datetime
import json

from notelens.functions import markdown
from notelens.operators import workflow
from notelens.sources import history, vault
from pyspark.sql import functions as F


def test_exported_log(spark, tmp_path):
    octal = "".join(f"\\{b:03o}" for b in "掘金".encode())
    log = "\0" + "2024-03-02\n\na.md\n\"dir/" + octal + " \\\"q\\\".md\"\n" + "\0" + "2024-01-05\n\na.md\nb c.md\n"
    (tmp_path / "log.txt").write_text(log)
    found = {r.path: r.revised for r in history.last_revisions(history.read_log(spark, f"file://{tmp_path}/log.txt")).collect()}
    assert found == {"a.md": datetime.date(2024, 3, 2), 'dir/掘金 "q".md': datetime.date(2024, 3, 2), "b c.md": datetime.date(2024, 1, 5)}


def test_folder_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    cut = lambda f: one(vault.index_excluded(F.lit(f), ("90-Archive",), ("*-raw", "tmp?")))
    assert [cut(f) for f in ("90-Archive", "90-Archive/x", "90-Archived", "20/data-raw", "tmp1", "a/tmp2", "tmp12")] == [True, True, False, True, True, True, False]
    names = {"Notes": True, " x": False, "a.": False, ".a": False, "con.txt": False, "a/b": False, "a" * 256: False, "é" * 128: False, "缓存": True, "": False, "x\t": False, "..": False}
    assert {n: one(vault.portable_name(F.lit(n))) for n in names} == names and one(vault.portable_name(F.lit(None).cast("string"))) is False
    paths = {"a/b.md": True, "../a": False, "a/../../b": False, "/a": False, "C:x": False, "a/../b": True, "": False, ".": False, "a\\..\\..\\b": False}
    assert {p: one(vault.inside(F.lit(p))) for p in paths} == paths


def test_titles_and_sections(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    title = lambda t, s: one(markdown.audit_title(F.lit(t), F.lit(s)))
    assert title("---\n# no\n---\n## two\n # One \n", "x") == "One" and title("text\n#\n", "2024-01-02-Plan") == "Plan" and title("```\n# in code\n```", "s") == "in code"
    body = "# T\n## A ##\none `code`\n```\n## no\n```\n### B\ntwo\n## C\n## A\nagain\n"
    row = spark.createDataFrame([(body,)], "b string").select(markdown.lines_of("b").alias("l")).select(markdown.section_headings(F.col("l")).alias("h"), markdown.second_level_sections(F.col("l")).alias("s")).first()
    assert row.h == ["A", "B", "C", "A"] and row.s == {"A": "one `code`\n### B\ntwo\nagain", "C": ""}


def test_memos_and_payloads(spark, tmp_path):
    rows = spark.createDataFrame([("09:00", 1, "a"), (None, 9, "b"), ("09:00", 4, "c"), ("10:00", 2, "d")], "at string, line int, text string")
    assert [r.text for r in workflow.memos(rows).collect()] == ["d", "c", "a", "b"]
    assert [json.loads(r.payload) for r in workflow.as_payload(rows.filter("line = 9")).collect()] == [{"at": None, "line": 9, "text": "b"}]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "p.png").write_bytes(b"12345")
    (tmp_path / "n.md").write_text("n")
    assert [(r.name, r.size) for r in vault.attachments(spark, f"file://{tmp_path}").collect()] == [("p.png", 5)]


def test_metadata_lists_are_trimmed_and_whole(spark):
    files = spark.createDataFrame([("a.md", "a", "---\ntags: [' v0 ', v1, 2x2, '']\naliases: one\n---\nx")], "path string, stem string, text string")
    row = markdown.notes_of(files).select("tags", "aliases").first()
    assert row.tags == ["v0", "v1", "2x2"] and row.aliases == ["one"]
