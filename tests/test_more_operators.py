"""Claims, labels, web clips and candidate folders, by hand-worked cases."""

from __future__ import annotations

from notelens.operators import audit, corpus, receipts
from pyspark.sql import functions as F


def test_claims(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    done = {"I saved the note.": True, "The note was not saved.": False, "笔记已保存": True, "Nothing to say": False, "I could not check, but your note is ready": True, "It is not true that the note is ready": False, "Saved successfully!": True}
    assert {t: one(receipts.claims_completion(F.lit(t))) for t in done} == done
    assert one(receipts.label_present(F.lit("数据为厂商自报"), "source-self-report")) and one(receipts.label_present(F.lit("Source self report"), "source-self-report"))
    assert not one(receipts.label_present(F.lit("社区来源"), "primary"))
    text = "The Handler Code is irrelevant; the chart is shown; 图表不重要"
    assert one(receipts.dismissed_subjects(F.lit(text), ["chart", "handler code", "图表"])) == ["handler code", "图表"]
    assert one(receipts.specific_blocker(F.lit("The handler code did not load"), ["handler code"]))
    assert not one(receipts.specific_blocker(F.lit("The handler code is irrelevant"), ["handler code"])) and not one(receipts.specific_blocker(F.lit("login wall"), ["handler code"]))


def test_web_clip_fields(spark):
    metas = {"a": '{"source": "https://a.org", "author": "Ann", "published": "2024-01-01", "capture_depth": "standard"}', "b": '{"source": "unknown", "author": "待补充", "published": true, "capture_depth": "deep"}', "c": '{"published": 2025, "author": "TBD: verify", "source": 5}', "d": "{}"}
    notes = spark.createDataFrame([(p, "web-clip" if p != "d" else "note", m) for p, m in metas.items()], "path string, type string, m string").withColumn("meta", F.parse_json("m")).drop("m")
    found = {(r.path, r.code.removeprefix("web-clip-")) for r in audit.findings(notes, audit.web_clip_rules()).collect()}
    assert found == {("b", "missing-source"), ("b", "missing-author"), ("b", "missing-published"), ("b", "invalid-capture-depth"), ("c", "missing-author"), ("c", "missing-source")}


def test_candidate_folders(spark):
    notes = spark.createDataFrame([("20/AI Agents/x.md", "Cache plan", ["ops"]), ("y.md", "Cache 缓存策略", None), ("20/Ops/z.md", "none", [])], "path string, title string, tags array<string>")
    folders = spark.createDataFrame([(f,) for f in ("20/AI Agents", "20/Ops", "20/Cache", "20/Plan B", "Cache", "缓存", "20/Cache/deep")], "folder string")
    got = {}
    for r in corpus.candidate_folders(notes, folders).orderBy("path", "place").collect():
        got.setdefault(r.path, []).append(r.folder)
    assert got == {"20/AI Agents/x.md": ["20/AI Agents", "20/Cache", "20/Ops"], "y.md": ["", "Cache", "缓存"], "20/Ops/z.md": ["20/Ops"]}


def test_duplicate_project_notes_name_the_first_paths(spark):
    notes = spark.createDataFrame([(f"p{i:02d}.md", "30-Projects", "one") for i in range(30)] + [("q.md", "30-Projects", "two")], "path string, entity_folder string, instance string")
    row = audit.duplicate_project_notes(notes, listed=3).collect()
    assert [(r.path, r.message, r.severity) for r in row] == [("30-Projects/one", "30 notes: p00.md, p01.md, p02.md", "defect")]


def test_clauses_end_before_a_conjunction_that_follows_a_sign(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(receipts.clauses(F.lit("Saved it；但是 not the note. Yet 2.5 holds, however: a！b"))) == ["saved it；", "not the note.", "2.5 holds,", ": a！", "b"]
