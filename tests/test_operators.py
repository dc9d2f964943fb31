"""Search, workflow, corpus and receipt operators on hand-worked rows."""

from __future__ import annotations

import hashlib
import json
import math
from difflib import SequenceMatcher

import pytest
from notelens.operators import corpus, receipts, reviews, search, workflow
from notelens.streaming import board
from pyspark.sql import functions as F


def test_bm25_by_hand(spark):
    notes = spark.createDataFrame([(1, "cache", "limit the cache\nother words here now"), (2, "none", "limit"), (3, "empty", "")], "path long, title string, body string")
    got = {r.path: (r.score, r.passage_no) for r in search.bm25(notes, {"cache": 1.0, "limit": 0.45}).collect()}
    names = {1: 6.0, 2: 6.0, 3: 6.0}
    mean = {1: 3.5, 2: 1.0, 3: 0.0}
    average = sum(names[i] + mean[i] for i in names) / 3
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda f, length, df, w: w * idf(df) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * length / average))
    first = part(7, 9.5, 1, 1.0) + part(1, 9.5, 2, 0.45)
    assert got[1] == (pytest.approx(first), 0)
    assert got[2][0] == pytest.approx(part(1, 7.0, 2, 0.45))
    assert got[3] == (0.0, 0)
    assert [r.path for r in search.top(search.bm25(notes, {"cache": 1.0, "limit": 0.45}), 5).collect()] == [1, 2]


def test_scores_do_not_depend_on_partitions(spark):
    notes = spark.range(200).selectExpr("id path", "concat('title ', id % 7) title", "concat('word ', id % 5, '\nline ', id % 3, ' word') body")
    runs = [[(r.path, round(r.score, 9)) for r in search.top(search.bm25(notes.repartition(n), {"word": 1.0, "3": 1.0}), 20).collect()] for n in (1, 4, 8)]
    assert runs[0] == runs[1] == runs[2]


def test_one_section_equals_whole_body(spark):
    notes = spark.createDataFrame([(1, "a b c"), (2, "b b")], "path long, body string")
    a, b = ({r.path: r.score for r in search.bm25(notes, {"b": 1.0}, sections=s).collect()} for s in (True, False))
    assert a == b


def test_filters_tally_sums_to_what_is_dropped(spark):
    notes = spark.createDataFrame([(1, "x", ["a"], None, None), (2, "y", ["Spring_Boots"], "2024-01-05", None), (3, "y", ["springboot"], "2024-02-05", "2024-03-01"), (4, "y", ["z"], "2024-02-05", None), (5, None, [], "2025-01-01", None)], "path long, type string, tags array<string>, date string, updated string")
    notes = notes.withColumns({"date": F.to_date("date"), "updated": F.to_date("updated")})
    f = search.Filters(types=("y", "x"), tags=("spring-boot", "a"), after="2024-02-01", updated_before="2024-02-28")
    assert {r.reason: r.excluded for r in f.tally(notes).collect()} == {"missing-date": 1, "after": 1, "updated-before": 1, "tag": 1, "type": 1}
    assert f.select(notes).count() == 0 and search.Filters().select(notes).count() == 5


def test_expansion():
    concepts = [search.Concept("b", ("limit", "限流 器")), search.Concept("a", ("缓存", "cache store")), search.Concept("c", ("limit", "cap"))]
    tokens, used, cut = search.expand_query("Limit 缓存 now", concepts)
    assert used == [("b", "limit", ["限流", "器"]), ("c", "limit", ["cap"]), ("a", "缓存", ["cache", "store"])]
    assert tokens == ["限流", "器", "cap", "cache", "store"] and not cut
    many = [search.Concept(f"k{i:02}", ("limit", f"w{i}")) for i in range(12)]
    assert search.expand_query("limit", many)[2] and len(search.expand_query("limit", many)[1]) == 8


def test_budget_skip_is_no_prefix():
    assert workflow.budget_skip([("a", 400), ("b", 700), ("c", 500)], 1000) == ["a", "c"]


def test_similar_titles_against_all_pairs(spark):
    titles = ["alpha beta", "alpha betas", "alpha bets", "gamma", "gamma 1", "gamma 2", "delta x", "delta xy", "x", "y", "aaaa", "aaaaa", "abcd"]
    got = {(r.a, r.b): r.ratio for r in corpus.similar_titles(spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    bare = lambda t: "".join(c for c in t if not c.isdigit())
    want = {(a, b): r for a in titles for b in titles if a < b and (r := SequenceMatcher(None, a, b).ratio()) >= 0.85 and not (bare(a) == bare(b) and bare(a))}
    assert got == pytest.approx(want) and got


def test_pairs_of_characters_merge(spark):
    counts = spark.createDataFrame([("知识", 5), ("识库", 5), ("库检", 5), ("别的", 5), ("检索", 4)], "term string, notes long").selectExpr("'f' folder", "*").unionByName(spark.createDataFrame([("g", "索引", 5)], "folder string, term string, notes long"))
    assert {(r.term, r.notes) for r in corpus.merge_pairs(counts).collect()} == {("知识库检", 5), ("别的", 5), ("检索", 4), ("索引", 5)}


def test_project_queue_order_and_reasons(spark):
    projects = spark.createDataFrame([(1, "active", "2024-01-01"), (2, "blocked", "2024-05-30"), (3, "done", None), (4, "active", None), (5, "active", "2024-05-30"), (6, "active", "2025-01-01"), (7, "active", "2024-01-01")], "path long, status string, updated string").withColumns({"updated": F.to_date("updated"), "date": F.lit(None).cast("date")})
    tasks = spark.createDataFrame([(1, 3, "b", False, False), (1, 2, "a", False, False), (7, 1, "x", False, False), (7, 2, "y", True, True), (2, 1, "go", False, True)], "path long, line int, text string, checked boolean, in_next_actions boolean")
    rows = reviews.queue_order(reviews.project_queue(projects, tasks, "2024-06-01"), 10).collect()
    assert [(r.path, r.priority, r.next_action) for r in rows] == [(2, 0, "go"), (4, 1, None), (1, 2, "a"), (7, 3, None)]
    assert rows[2].reasons == "stale:152-days,open-tasks:2" and rows[3].open_tasks == 1 and rows[3].ranking_tasks == 0


def test_retention_is_closed_on_a_bad_policy(spark):
    backups = spark.createDataFrame([("p%d" % i, "n", "s", i) for i in range(5)], "path string, relative_note string, stamp string, mtime long")
    assert {r.path for r in workflow.retention(backups, 2, F.col("path") == "p0").filter("deleted").collect()} == {"p1", "p2", "p3"}
    assert workflow.retention(backups, 0).filter("deleted").count() == 0


def test_log_cap_and_cache(spark):
    log = spark.createDataFrame([("a", i, "t") for i in range(5)], "path string, line int, text string")
    assert {r.line for r in workflow.log_cap(log, 2).collect()} == {3, 4}


def receipt(text, **changes):
    base = {"schema_version": 1, "content_sha256": hashlib.sha256(text.encode()).hexdigest(), "source_access": "complete", "primary_sources": ["https://a.org/x"], "supplemental_sources": [], "resources": [{"id": "r", "name": "R", "canonical_url": "https://r.org"}], "numeric_claims": [{"note_excerpt": "grew 20 %", "provenance": "p", "source": "s"}]}
    return json.dumps(base | changes)


def test_receipts(spark):
    text = "It grew 20 % with https://r.org in use."
    cases = {
        None: receipt(text), "invalid-capture-receipt": receipt(text, schema_version=2), "capture-receipt-content-mismatch": receipt(text + "!"), "incomplete-source-access": receipt(text, source_access="partial"),
        "source-receipt-mismatch": receipt(text, primary_sources=["https://b.org"]), "incomplete-resource-evidence": receipt(text, resources=[{"id": "q", "name": "Q", "canonical_url": "https://q.org"}]),
        "unresolved-items": receipt(text, unresolved_items=["x"]), "missing-excerpt": receipt(text, numeric_claims=[{"note_excerpt": "fell 3 %"}]), "uncovered-numeric-claim": receipt(text, numeric_claims=[]),
    }
    rows = [(str(i), r, text, "verified", "https://a.org/x", c) for i, (c, r) in enumerate(cases.items())] + [("n", "{", text, "verified", "https://a.org/x", "invalid-capture-receipt"), ("d", receipt(text), text, "standard", "https://a.org/x", "capture-receipt-depth-mismatch")]
    df = spark.createDataFrame(rows, "path string, receipt string, rendered string, depth string, source string, want string")
    got = {r.path: r.code for r in receipts.judge(df).collect()}
    assert got == {r[0]: r[5] for r in rows}


def test_manifest_claims_and_metadata(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "path string, sha256 string")
    assert {r.path: r.state for r in receipts.manifest_diff(a, b).collect()} == {"y": "changed", "z": "missing", "w": "extra"}
    one = lambda c: spark.range(1).select(c).first()[0]
    groups = [["written", "saved"], ["note"]]
    assert one(receipts.forbidden_claim(F.lit("First. The note was saved; done."), groups))
    assert not one(receipts.forbidden_claim(F.lit("The note was not saved. Saved it is!"), groups))
    assert {v: one(receipts.placeholder_metadata(F.lit(v))) for v in ("TBD", " n/a ", "2024", None, "unknown author", "待补充", "待补充内容", "ＴＢＤ", "todo: verify", "untitled", "xx", "unknown unknowns")} == {
        "TBD": True, " n/a ": True, "2024": False, None: True, "unknown author": True, "待补充": True, "待补充内容": True, "ＴＢＤ": True, "todo: verify": True, "untitled": False, "xx": False, "unknown unknowns": False}
    said = {"The file is unavailable, so the note was not written": False, "There is no plan; the note was written": True, "without haste the note was written": True, "笔记 note 未写入 written": False}
    assert {t: one(receipts.forbidden_claim(F.lit(t), [["note"], ["written"]])) for t in said} == said
    spans = {"用时 3小时 and 5%": ["3小时", "5%"], "花了2万 and 1.5亿": ["2万", "1.5亿"], "scored 4/5, ⭐ 12k": ["4/5", "⭐ 12k"], "1,234,567+ users in 3 days": ["1,234,567+", "3 days"], "v2 of 2024, x5%": []}
    assert {t: one(receipts.metric_spans(F.lit(t))) for t in spans} == spans
    assert one(F.round(receipts.soft_score(F.lit(1.0), F.lit(0.5), F.lit(1.0), F.lit(14), F.lit(0.0)), 3)) == 0.7


def test_uncovered_and_missing(spark):
    spans = spark.createDataFrame([(1, 5, 9), (1, 20, 25), (2, 5, 9)], "doc int, start int, end int")
    excerpts = spark.createDataFrame([(1, 0, 9), (2, 6, 30)], "doc int, start int, end int")
    assert {tuple(r) for r in workflow.uncovered_spans(spans, excerpts).collect()} == {(1, 20, 25), (2, 5, 9)}


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = board.board_state(board.event_stream(spark, f"file://{tmp_path}/in", 1))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("board").trigger(availableNow=True).start()
    query.awaitTermination()
    want = source.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("last_type"), F.count(F.lit(1)).alias("actions"))
    assert {tuple(r) for r in spark.table("board").collect()} == {tuple(r) for r in want.collect()}
    hours = board.hourly_counts(board.event_stream(spark, f"file://{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    hours.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == source.count()
