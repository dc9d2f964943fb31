"""Cases that an earlier version got wrong, with and without adaptive execution."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from notelens.functions import markdown
from notelens.functions.text import tokenize
from notelens.operators import links, reviews
from notelens.plans import catalogue
from notelens.sources.vault import capture_scan
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_near_names_by_hand(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = {r.title: r.boost for r in catalogue.queries()["name_fuzzy_boost"](spark, SF).collect()}
        pairs = catalogue.queries()["similar_titles"](spark, SF).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    names = {r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()}
    ratio = lambda n: SequenceMatcher(None, "smal rings", " ".join(n.lower().split())).ratio()
    assert got == {n: round(4 * ratio(n), 6) for n in names if ratio(n) >= 0.72}
    assert all(r.ratio >= 0.85 for r in pairs)


def test_finished_projects_in_both_languages(spark):
    rows = [("a", "已完成"), ("b", " Done "), ("c", "shipped"), ("d", "归档"), ("e", None), ("f", "abandoned")]
    projects = spark.createDataFrame([(p, s, None, None) for p, s in rows], "path string, status string, updated date, date date")
    tasks = spark.createDataFrame([], "path string, line int, text string, checked boolean, in_next_actions boolean")
    assert {r.path for r in reviews.project_queue(projects, tasks, "2024-01-01").collect()} == {"c", "e", "f"}


def test_every_dependency_marker_counts(spark):
    rows = [("s", "t", 3, "It builds on x and references t.", None, "resolved"), ("s", "t", 2, "See t.", None, "resolved"), ("s", "u", 4, "基于 u 的设计", None, "resolved"), ("s", "v", 1, "cites v", "moc", "resolved"), ("s", "w", 1, "cites w", None, "unresolved")]
    found = links.directed_dependencies(spark.createDataFrame(rows, "source string, target string, line int, sentence string, type string, state string"))
    assert [tuple(r) for r in found.collect()] == [("s", "t", 3, "references"), ("s", "u", 4, "基于")]
    many = tuple(f"phrase {i} " for i in range(1500))
    one = spark.createDataFrame([("s", "t", 1, "a phrase 1499 here", None, "resolved")], "source string, target string, line int, sentence string, type string, state string")
    assert links.directed_dependencies(one, many).first().marker == "phrase 1499 "


def test_sentences_and_related_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    text = "First one. Second has [[x]]! 第三句。Fourth\nnext line 1.5 times. End"
    at = lambda word: one(links.sentence_at(F.lit(text), F.lit(text.index(word))))
    assert [at(w) for w in ("First", "[[x", "第三", "Fourth", "1.5", "End")] == ["First one.", "Second has [[x]]!", "第三句。", "Fourth", "next line 1.5 times.", "End"]
    names = F.array(*map(F.lit, ["[[Cache Plan|the plan]]", "bare name", " [[a/b#part]] ", "", "[[cache plan]]"]))
    assert one(links.related_names(names)) == ["cache plan", "bare name", "a/b"]


def test_blocks_of_lines():
    cases = {
        "a\n```py\nx\n``` \nb": "01110", "~~~\n```\n~~~\nz": "1110", "```a`b\nx": "00", "<!-- c\n```\n-->\n```\ny\n```": "000111", "````\n```\n````\nq": "1110", "  ```\nx\n   ```\ny": "1110",
        "    ```\nx": "00", "<!-- one --> <!-- two\n```\nend --> ```\nk": "0111", "```\nnever": "11",
    }
    for text, want in cases.items():
        rows = markdown.scan_lines(text)
        assert "".join(str(int(r[3])) for r in rows) == want, text
        assert {r[6] for r in rows} == {text.endswith(("never", "end --> ```\nk"))}
    assert markdown.parse_meta("--- \na: 1\n---\nx")[0] is False and markdown.parse_meta("---\na: 1\n--- \nx")[2] == "unclosed-frontmatter"


def test_copies_are_no_captures(spark):
    files = spark.createDataFrame([("a.md", ["Notes"]), ("b.md", [".notelens-backups", "x"]), ("c.md", ["Attachments"]), ("d.md", ["Templates"])], "name string, folder_parts array<string>")
    assert {r.name for r in capture_scan(files).collect()} == {"a.md", "c.md"}


def test_generic_title_tokens(spark):
    from notelens.functions.text import title_tokens

    row = spark.range(1).select(title_tokens(F.lit("The cache guide 缓存指南 and index")).alias("t"), tokenize(F.lit("x")).alias("u")).first()
    assert set(row.t) == {"the", "cache", "缓存", "存指", "and", "index"}


def test_boards_have_no_open_loops(spark):
    notes = spark.createDataFrame([("a.md", "note"), ("b.md", "todo-board"), ("c.md", None)], "path string, type string").withColumn("date", F.lit(None).cast("date"))
    tasks = notes.select("path", F.lit(1).alias("line"), F.lit("do").alias("text"), F.lit(False).alias("checked"), F.lit(True).alias("in_next_actions"))
    assert {r.path for r in reviews.open_loops(tasks, notes).collect()} == {"a.md", "c.md"}


def test_filters_say_what_holds():
    from notelens.operators.search import Filters

    assert Filters(types=("en",), before="2024-01-01").applied() == {"types": ("en",), "before": "2024-01-01"} and Filters().applied() == {}
