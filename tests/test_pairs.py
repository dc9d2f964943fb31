"""Overlapping pairs against a plain reading of the rule, and on the documents."""

from __future__ import annotations

import random
from collections import defaultdict

from notelens.operators import corpus
from notelens.plans import table_queries

SMALL = "/root/testdata/sf0.001"


def plain(rows):
    groups, out = defaultdict(set), set()
    for folder, term, notes in rows:
        if len(term) == 2:
            groups[folder, notes].add(term)
        else:
            out.add((folder, term, notes))
    for (folder, notes), terms in groups.items():
        taken = set()
        for head in sorted(terms):
            if any(t[1] == head[0] for t in terms):
                continue
            chain = head
            taken.add(head)
            while after := [t for t in sorted(terms - taken) if t[0] == chain[-1]]:
                chain += after[0][1]
                taken.add(after[0])
            out.add((folder, chain, notes))
        out |= {(folder, t, notes) for t in terms - taken}
    return out


def test_merged_pairs_equal_the_plain_rule(spark):
    rng = random.Random(2)
    rows = [(rng.choice("fg"), rng.choice("abcdefgh") + rng.choice("abcdefgh"), rng.randint(1, 4)) for _ in range(160)]
    rows += [("h", "".join(p), 7) for p in zip("qwertyuiop", "wertyuiopa", strict=True)] + [("h", "abc", 7), ("h", "x", 1), ("k", "aa", 1), ("k", "ab", 1), ("k", "ba", 1)]
    got = {tuple(r) for r in corpus.merge_pairs(spark.createDataFrame(rows, "folder string, term string, notes long").repartition(4)).collect()}
    assert got == plain(rows) and ("h", "qwertyuiopa", 7) in got


def test_empty(spark):
    assert corpus.merge_pairs(spark.createDataFrame([], "folder string, term string, notes long")).isEmpty()


def test_chains_of_documents(spark):
    import re

    held = defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        for w in re.findall(r"[^\W\d_]{2,}", (r.text or "").lower()):
            for i in range(len(w) - 1):
                held[r.lang, w[i : i + 2]].add(r.doc_id)
    rows = [(lang, pair, len(ids)) for (lang, pair), ids in held.items() if lang is not None]
    assert {tuple(r) for r in table_queries.character_chains(spark, SMALL).collect()} == plain(rows)
