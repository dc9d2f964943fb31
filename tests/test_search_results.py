"""Snippets, matched words and expansion of results, against plain Python."""

from __future__ import annotations

import random
import re

from notelens.operators import search as S
from pyspark.sql import functions as F


def plain_snippet(lines, start, end, tokens):
    """(line, hits, text) of the best line of a section by the rules of RNK-14."""
    rated = []
    for i in range(start, min(end, len(lines))):
        found = S.query_tokens(lines[i][0])
        rated.append((-sum(min(found.count(t), 3) for t in set(tokens)), lines[i][1] > 0, i))
    hit = [r for r in rated if r[0] < 0]
    shown = [i for _, head, i in rated if not head and lines[i][0].strip()]
    at = min(hit)[2] if hit else shown[0] if shown else None
    if at is None:
        return None, 0, ""
    near = [lines[i][0].strip() for i in range(max(start, at - 1), min(end, len(lines), at + 2)) if lines[i][0].strip() and not lines[i][1]]
    text = re.sub(r"\s+", " ", " ".join(near)).strip()
    return at + 1, -min(hit)[0] if hit else 0, text if len(text) <= 480 else text[:479].rstrip() + "…"


def test_section_snippet(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(120):
        lines = [(" ".join(rng.choice(["cache", "plan", "x", "yy", "", "缓存命中"]) for _ in range(rng.choice([0, 3, 3, 8, 150 if i % 20 == 0 else 4]))), rng.choice([0, 0, 0, 2])) for _ in range(rng.randint(1, 9))]
        start = rng.randrange(len(lines))
        end = rng.randint(start, len(lines) + 1)
        rows.append((i, [(t, h, t if h else None) for t, h in lines], start, end))
        want[i] = plain_snippet(lines, start, end, ["cache", "plan", "缓存"])
    notes = spark.createDataFrame(rows, "path int, lines array<struct<text:string,heading_level:int,heading:string>>, start_line int, end_line int")
    got = {r.path: (r.line, r.hits, r.snippet) for r in S.section_snippet(notes, ["cache", "plan", "缓存"]).collect()}
    assert got == want


def test_search_with_scope_words_and_concepts(spark):
    rows = [("work/a.md", "Cache plan", ["缓存"], ["infra"], "nothing here\nlimits and eviction of caches"), ("work/b.md", "Other", [], ["cache"], "plan the eviction\neviction eviction"), ("home/c.md", "Cache plan", [], [], "eviction"), ("work/d.md", "Far", [], [], "none")]
    notes = spark.createDataFrame(rows, "path string, title string, aliases array<string>, tags array<string>, body string")
    concepts = (S.Concept("cache", ("cache", "eviction", "缓存")),)
    found = {r.path: r for r in S.search(notes, "cache plan", 5, scope="work", concepts=concepts).collect()}
    assert set(found) == {"work/a.md", "work/b.md"}
    a, b = found["work/a.md"], found["work/b.md"]
    assert [(s.kind, s.detail) for s in a.signals] == [("title", "cache, plan")]
    assert {(m.field, tuple(m.words)) for m in b.matched} == {("tags", ("cache",))} | ({("body", ("plan",))} if b.passage_no == 0 else set())
    assert [(s.kind, s.detail) for s in a.expansion] == [("expansion", "cache → eviction, 缓存")]
    assert found["work/a.md"].score > found["work/b.md"].score and a.snippet


def test_tokens_of_texts_with_odd_letters(spark):
    from notelens.functions.text import tokenize

    texts = ["Straße Ärger", "KELVIN K9 İz", "mixed 缓存 text", "a_b-c 1.5", "", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(tokenize(F.col("x")).alias("t")).collect()]
    assert got == [S.query_tokens(t or "") for t in texts]
