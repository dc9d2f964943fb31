"""Boards, resume packs, templates and names on hand-worked rows."""

from __future__ import annotations

import pytest
from notelens.operators import boards, resume
from pyspark.sql import functions as F

HEAD = "---\ntype: todo-board\ntags: [todo]\n---\n"
BOARD = HEAD + "\n# 待办\n\n## 今天\n\n- [ ] call 📅 2024-01-01\n## 之后\n\n- [ ] pay 📅 2024-01-09\n## 没定日子\n\n- [ ] read\n## 备忘\n\n- 2024-01-01 09:30 note\n## 已完成\n\n- 2024-01-01 勾掉：old\n"


def test_round_trip_and_changes():
    board = boards.parse(BOARD)
    assert board.render() == BOARD
    after = boards.change(board, "tick", "call", "2024-01-10")
    assert [(r.section, r.text) for r in after.rows] == [("今天", "pay"), ("没定日子", "read"), ("备忘", "note"), ("已完成", "old"), ("已完成", "call")]
    later = boards.change(after, "reschedule", "read", "2024-01-10", due="2024-02-01")
    assert [r.text for r in later.rows if r.section == "之后"] == ["read"]
    for args, code in [(("capture", "pay"), "board-duplicate"), (("tick", "none"), "board-no-match"), (("cancel", "old"), "board-no-match")]:
        with pytest.raises(boards.BoardError, match=code):
            boards.change(board, *args, "2024-01-01")


@pytest.mark.parametrize(("text", "code"), [("x", "frontmatter"), (BOARD.replace("## 之后", "## 然后"), "heading"), (BOARD + "```\n", "fence"), (BOARD.replace("2024-01-09", "2024-02-30"), "pattern"), (BOARD.replace("- [ ] read", "- [ ] read 📅 2024-01-01"), "pattern"), (HEAD, "heading")])
def test_what_is_no_board(text, code):
    with pytest.raises(boards.BoardError, match=code):
        boards.parse(text)


def test_table_of_boards(spark):
    rows, bad = boards.board_rows(spark.createDataFrame([("a", BOARD), ("b", "x"), ("c", None)], "path string, text string"))
    assert rows.filter("path = 'a'").count() == 5 and [tuple(r) for r in bad.collect()] == [("b", "frontmatter")]


def test_resume(spark):
    sections = spark.createDataFrame([("p", "Status ", 9, "later"), ("p", "state", 3, "now"), ("s", "Next", 2, "go"), ("s", "Status", 4, "mine")], "path string, section string, from int, text string")
    vocabulary = {"state": ("Status", "State"), "next": ("Next",), "risk": ("Risks",)}
    fields = resume.resume_fields(sections, vocabulary)
    assert {(r.path, r.field): r.text for r in fields.collect()} == {("p", "state"): "now", ("s", "state"): "mine", ("s", "next"): "go"}
    paths = spark.createDataFrame([("p",)], "path string")
    members = spark.createDataFrame([("p", "s")], "project string, path string")
    row = resume.missing_and_contested(fields, paths, members, ("state", "next", "risk")).first()
    assert (row.missing, row.contested) == (["risk"], ["state"])
    lines = spark.createDataFrame([("p", 1, "Status", 2), ("p", 5, "Other", 2), ("p", 7, None, 0)], "path string, line int, heading string, heading_level int")
    report = resume.heading_report(lines, vocabulary).first()
    assert (report.matched, report.unmatched) == (["Status"], ["Other"])


def test_members(spark):
    notes = spark.createDataFrame([("a/p.md", "a", None, "2024-01-01"), ("a/x.md", "a", "Plan", "2024-01-02"), ("b/y.md", "b", "plan", None), ("b/z.md", "b", None, "2024-01-03"), ("b/t.md", "b", "Twin", None)], "path string, folder string, project string, date string")
    projects = spark.createDataFrame([("a/p.md", "Plan", "a"), ("c/1.md", "Twin", "c"), ("d/2.md", "Twin", "d")], "project string, name string, folder string")
    related = spark.createDataFrame([("b/z.md", "PLAN"), ("b/y.md", "plan")], "path string, name string")
    got = [(r.path, r.trust, r.origins) for r in resume.project_members(notes, projects, related).orderBy("place").collect()]
    assert got == [("a/x.md", 0, ["location", "project-field"]), ("b/y.md", 1, ["project-field", "related-link"]), ("b/z.md", 2, ["related-link"])]


def test_folders_templates_names(spark):
    folders = spark.createDataFrame([("x/a",), ("x/b",), ("x/c",), ("x/d",)], "folder string")
    files = spark.createDataFrame([("x/a/a.md", "x/a", "a.md", True), ("x/b/INDEX.md", "x/b", "INDEX.md", True), ("x/c/c.md", "x/c", "c.md", True), ("x/c/INDEX.md", "x/c", "INDEX.md", True), ("x/d/d.md", "x/d", "d.md", False)], "path string, folder string, name string, declares boolean")
    assert {r.folder: r.code for r in resume.folder_indexes(folders, files).collect()} == {"x/b": "misnamed-folder-index", "x/c": "duplicate-folder-index", "x/d": "missing-folder-index"}
    note = spark.createDataFrame([("n", 1, "A", 3), ("n", 2, "B", 2)], "path string, line int, heading string, heading_level int")
    template = spark.createDataFrame([("A", 2), ("B", 2)], "heading string, heading_level int")
    assert [tuple(r) for r in resume.heading_repairs(note, template).collect()] == [("n", 1, "A", 3, 2)]
    wanted = spark.createDataFrame([("f", "T/1", 1), ("f", "T/1", 2), ("f", "U", 3)], "folder string, title string, at int")
    existing = spark.createDataFrame([("f", "T_1.md"), ("f", "T_1-2.md")], "folder string, name string")
    assert sorted(r.name for r in resume.unique_names(wanted, existing).collect()) == ["T_1-3.md", "T_1-4.md", "U.md"]
    starters = spark.createDataFrame([("a", b"x")], "name string, content binary").withColumn("sha256", F.sha2("content", 256))
    assert [r.name for r in resume.customised_templates(spark.createDataFrame([("a", "x"), ("b", "y")], "name string, content string"), starters).collect()] == ["b"]


def test_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    maps = [F.create_map(*[F.lit(x) for x in kv]) for kv in (("a", "1", "b", "1", "c", "1", "d", "1"), ("b", "2", "c", "2", "d", "2"), ("c", "3", "d", "3"), ("d", "4"))]
    assert one(resume.merged_metadata(*maps)) == {"a": "1", "b": "2", "c": "3", "d": "4"}
    assert one(resume.render_template(F.lit("x {{date}}\n# {{title}} old\nrest"), F.lit("New"), F.lit("2024"))) == "x 2024\n# New\nrest"
    assert one(resume.archive_stem(F.lit("a/b"), F.lit("2024-01-01"))) == "2024-01-01 a_b·原文"
    assert one(resume.git_path(F.lit(r'"a\347\237\245 \"b\".md"'))) == 'a知 "b".md' and one(resume.git_path(F.lit("plain.md"))) == "plain.md"
    assert one(resume.extend_list(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == ["a", "b", "c"]
    assert one(resume.first_refusal([("x", F.lit(None).cast("boolean")), ("y", F.lit(True)), ("z", F.lit(True))])) == "y"
    kept = resume.archive(spark.createDataFrame([("p", "https://a", "one\r\n---\ntwo")], "path string, source string, content string"))
    assert kept.select(resume.archived_content(F.col("text"))).first()[0] == "one\r\n---\ntwo"
    files = spark.createDataFrame([("INDEX.md", "```dataview\n```")], "path string, text string")
    assert resume.index_mode(files).first()[0] == "dataview" and resume.index_mode(files.limit(0)).first()[0] == "static"


def test_resume_pack_is_bounded_and_tells_what_is_contested(spark):
    projects = spark.createDataFrame([("p",), ("q",), ("none",)], "project string")
    members = spark.createDataFrame([("p", f"n{i}", i, ["location"], None) for i in range(1, 8)] + [("q", "n1", 1, ["related-link"], None)], "project string, path string, place int, origins array<string>, date date")
    fields = spark.createDataFrame([("p", "goal", "own"), ("n1", "goal", "first"), ("n2", "goal", "second"), ("n2", "evidence", "e"), ("n6", "evidence", "beyond"), ("n7", "blockers", "beyond")], "path string, field string, text string")
    got = {r.project: r for r in resume.resume_pack(projects, fields, members, ("goal", "decisions"), 5).collect()}
    p = got["p"]
    assert p.resume == {"goal": "own"} and p.contested == ["goal"] and p.missing == ["decisions"] and (p.sources_available, p.truncated) == (7, True)
    assert [s.path for s in p.sources] == ["n1", "n2", "n3", "n4", "n5"]
    assert {f: [(x.path, x.text) for x in xs] for f, xs in p.from_sources.items()} == {"goal": [("n1", "first"), ("n2", "second")], "evidence": [("n2", "e")]}
    q, none = got["q"], got["none"]
    assert q.resume == {} and q.contested == [] and q.missing == ["goal", "decisions"] and not q.truncated
    assert none.sources == [] and none.from_sources == {} and none.sources_available == 0
