"""Cases that an earlier version of an operator left out."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from notelens.operators import corpus, links, receipts, search
from notelens.plans import table_queries


def brute_boost(query, names):
    norm = lambda s: " ".join(search.query_tokens(s or ""))
    if norm(query) in map(norm, names):
        return 12.0
    best = max((SequenceMatcher(None, norm(query), norm(n)).ratio() for n in names), default=0.0)
    return 4.0 * best if best >= 0.72 else 0.0


def test_name_boost_enters_the_ranking(spark):
    rng = random.Random(4)
    query = "cache plan notes"
    garble = lambda: "".join(c for c in query if rng.random() > 0.15) + rng.choice(["", "x", " more", " 缓存"])
    rows = [(i, rng.choice([None, "other", garble(), garble()]), [garble() for _ in range(rng.randint(0, 2))], rng.choice(["cache", "words", "plan plan"])) for i in range(80)]
    rows += [(100, "none", ["Cache  PLAN notes!"], "words"), (101, "caches plain notess", [], "words"), (102, "Cache plan notes", None, ""), (103, "cach pla note", [], "words")]
    notes = spark.createDataFrame(rows, "path long, title string, aliases array<string>, body string")
    lexical = {r.path: r.score for r in search.bm25(notes, dict.fromkeys(search.query_tokens(query), 1.0)).collect()}
    want = {i: lexical[i] + brute_boost(query, [t, *(a or [])]) for i, t, a, _ in rows}
    got = {r.path: r.score for r in search.ranked(notes, query).collect()}
    assert got == pytest.approx(want)
    order = sorted((i for i in want if want[i] > 0), key=lambda i: (-want[i], str(i)))
    assert [r.path for r in search.top(search.ranked(notes, query), 90).collect()] == order
    assert lexical[103] == 0.0 and 103 in order and want[100] >= 12.0  # a near title without a token; an exact alias


def test_name_boost_reads_the_raw_query_only(spark):
    notes = spark.createDataFrame([(1, "cap"), (2, "limit")], "path long, title string").selectExpr("*", "'' body")
    assert {r.path: r.boost for r in search.ranked(notes, "limit", ["cap"]).collect()} == {1: 0.0, 2: 12.0}


def test_links_by_path(spark):
    notes = spark.createDataFrame([("10-Work/Cache plan.md", []), ("20/Cache plan.md", []), ("20/sub/x.md", []), ("root.md", []), ("20/v1.5 plan.md", []), ("lone.md", [])], "path string, aliases array<string>")
    cases = {
        ("root.md", "10-work/cache plan"): "10-Work/Cache plan.md", ("root.md", "10-work/cache plan.md"): "10-Work/Cache plan.md", ("20/Cache plan.md", "sub/x"): "20/sub/x.md",
        ("20/Cache plan.md", "sub/x.md"): "20/sub/x.md", ("20/sub/x.md", "../cache plan"): "20/Cache plan.md", ("20/sub/x.md", "../../root"): "root.md", ("root.md", "../root"): None,
        ("root.md", "30/cache plan"): None, ("root.md", "/10-work/cache plan"): None, ("root.md", "cache plan"): "ambiguous", ("20/sub/x.md", "root"): "root.md",
        ("root.md", "20/v1.5 plan"): None, ("root.md", "20/v1.5 plan.md"): "20/v1.5 plan.md",
    }
    edges = spark.createDataFrame([(s, i, n, "body") for i, (s, n) in enumerate(cases)], "source string, line int, name string, origin string")
    resolved = links.resolve(edges, links.link_keys(notes))
    assert {(r.source, r.name): "ambiguous" if r.state == "ambiguous" else r.target for r in resolved.collect()} == cases
    alone = links.orphans(notes.select("path"), resolved, notes.filter("path = 'root.md'").select("path"))
    assert {r.path for r in alone.collect()} == {"lone.md"}


def test_every_occurrence_of_every_excerpt(spark, tmp_path):
    docs = [(1, "aaaa b"), (2, "one two three four fives and one two three four five"), (3, "x one two three four five six y one two three four five six"), (4, "é ana banana"), (5, "")]
    items = [(1, "aa"), (2, "one two three four five"), (3, "one two three four five six"), (4, "ana"), (5, "zz"), (6, "two thr")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(d, i, p + 1) for d, t in docs for i, x in items for p in range(len(t)) if t.startswith(x, p)}
    got = [(r.doc_id, r.item_id, r.position) for r in table_queries.evidence_occurrences(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = {(r.doc_id, r.item_id, r.position) for r in table_queries.evidence_containment(spark, str(tmp_path)).collect()}
    assert first == {(d, i, min(p for a, b, p in want if (a, b) == (d, i))) for d, i, _ in want}


def test_metric_spans_need_a_covering_span(spark):
    from tests.test_operators import receipt

    cases = {"It fell 5%. It grew 15% with https://r.org": ["grew 15%"], "It grew 5% with https://r.org": ["grew 5%"], "Up 5%, then up 5% with https://r.org": ["up 5%", "Up 5%"], "Up 5%, then up 5% of https://r.org": ["up 5%"]}
    rows = [(t, receipt(t, numeric_claims=[{"note_excerpt": x} for x in xs])) for t, xs in cases.items()]
    df = spark.createDataFrame([(t, r, t, "verified", "https://a.org/x") for t, r in rows], "path string, receipt string, rendered string, depth string, source string")
    assert [receipts.judge(df).filter(f"path = '{t}'").first().code for t in cases] == ["uncovered-numeric-claim", None, None, "uncovered-numeric-claim"]


def test_similar_titles_at_the_floor(spark):
    long, short = "abcdefghijklmnopq" + "123456", "abcdefghijklmnopq"  # 2 * 17 / 40
    long = long.translate(str.maketrans("123456", "uvwxyz"))
    titles = [long, short, *[short[:k] + "#" for k in range(1, 9)], *[short[k:] + "!" for k in range(9)]]
    got = {(r.a, r.b) for r in corpus.similar_titles(spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    want = {(a, b) for a in titles for b in titles if a < b and SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert got == want and (short, long) in want
