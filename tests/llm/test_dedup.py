"""Exact dedup, substring dedup and the Jaccard join against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from notelens.llm import exact_dedup, jaccard_join, substring_dedup, suffix_array
from notelens.llm.components import connected_components
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, keep_id string, n long"  # extra columns with clashing names


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)


def words(rng, n):
    return " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(n))


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (6, "one"), (None, "lonely text with no id"), (7, "é" * 150), (8, "é" * 150), (8, "é" * 150), (9, "long " * 30000)]


def test_exact_dedup(spark):
    rng = random.Random(5)
    rows = EDGES + [(i, words(rng, 2)) for i in range(20, 60)]
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, docs_of(spark, rows)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        assert got[i, hashlib.sha256((t or "").encode()).hexdigest()] == (keep, len(ids), i == keep)


def test_exact_dedup_tells_texts_of_one_digest_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.unhex(F.sha2(F.lit("same").cast("binary"), 256)))
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, docs_of(spark, rows)).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (4, 2), 4: (4, 2), 5: (5, 1)}


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    found = lambda rows: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, docs_of(spark, rows), state_root=root).collect())
    first = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert found([(1, "a"), (2, "a"), (3, "b")]) == first
    assert found([(1, "a"), (2, "a"), (3, "b")]) == first  # the same call again counts nothing twice
    assert found([(2, "a"), (7, "a"), (9, "c")]) == [(2, 7, 3, False), (7, 7, 3, True), (9, 9, 1, True)]
    assert found([(3, "b")]) == [(3, 3, 1, True)]


def test_locators_find_the_text(spark, tmp_path):
    rows = [(i, t) for i, t in EDGES] + [(i, f"t{i % 7}") for i in range(20, 60)]
    docs_of(spark, rows).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    places = {(r.file, r.row): (r.doc_id, r.text or "") for r in docs.select("doc_id", "text", "_metadata.file_path", "_metadata.row_index").toDF("doc_id", "text", "file", "row").collect()}
    for r in exact_dedup.exact_dedup(spark, docs.filter("doc_id is null or doc_id <> 4")).collect():
        keep_id, text = places[r.locator.file, r.locator.row]
        assert keep_id == r.keep_id and hashlib.sha256(text.encode()).hexdigest() == r.text_sha256
        assert places[r.place.file, r.place.row] == (r.doc_id, text)


def test_drop_copies_keeps_all_columns(spark):
    rows = [(None, "a"), (None, "b"), (5, "a"), (5, "a"), (6, "c"), (6, "d"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "keep", "meta", 1) for i, t in rows], "doc_id long, text string, `place` string, `_metadata` string, `a.b` long")
    kept = exact_dedup.drop_copies(spark, docs)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {("keep", "meta", 1)}
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == [(0, "b"), (5, "a"), (6, "c"), (6, "d"), (8, "")]


def test_empty_tables(spark):
    empty = docs_of(spark, EDGES).limit(0)
    assert exact_dedup.exact_dedup(spark, empty).count() == 0
    assert jaccard_join.jaccard_components(spark, empty).count() == 0
    assert substring_dedup.remove_repeats(spark, empty).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rng = random.Random(seed)
    passage = words(rng, 12)
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "x " * 4000)]
    for i in range(10, 110):
        if i % 3 and len(rows) > 12:
            w = rng.choice(rows[8:])[1].split()
            for _ in range(rng.randint(0, 2)):  # chains and stars of near copies
                w[rng.randrange(len(w))] = rng.choice(["new", "other", "third"])
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, words(rng, rng.choice([6, 12, 13, 20, 40, 150])) + (" " + passage if i % 2 else "")))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark, docs_of(spark, rows), group_docs=3).collect()}
    assert got == brute_components(rows)


def test_signatures_meet_for_every_link():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(9, 60))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        out = int(rng.integers(0, len(a) // 9 + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[out:]], rng.integers(0, 2**63, int(rng.integers(0, len(a) // 9 + 2)), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 90 * (len(a) + len(b) - shared) and shared < max(len(a), len(b)):
            assert set(jaccard_join.signatures(a).tolist()) & set(jaccard_join.signatures(b).tolist())


def test_components_of_chains_and_cycles(spark):
    links = [(i + 1, i) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100)]
    got = {r.node: r.comp for r in connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 101, 102)}


def brute_cut(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        if i is None:  # neither smaller nor greater than another
            out[i] = (len(b), 0, 0, b)
            continue
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("seed", "contexts"), [(1, 5_000), (2, 5_000), (3, 1), (4, 3)])
def test_substring_dedup(spark, monkeypatch, seed, contexts):
    monkeypatch.setattr(substring_dedup, "SHARD_CONTEXTS", contexts)
    rng = random.Random(seed)
    base = [words(rng, 60) for _ in range(4)]
    rows = [(None, base[0] + " no id"), (1, None), (2, ""), (3, "short"), (4, "a" * 99), (5, "a" * 100), (6, "a" * 450), (7, "ab" * 200), (8, "é" * 120), (9, "xé" * 90)]
    for i in range(20, 50):
        parts = [words(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(base)
            a = rng.randrange(len(s))
            parts += [s[a : a + rng.randint(50, 250)], words(rng, rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.remove_repeats(spark, docs_of(spark, rows)).collect()}
    assert got == brute_cut(rows)


def test_suffix_array_against_sorting():
    rng = random.Random(3)
    for trial in range(300):
        b = bytes(rng.randrange(rng.choice([1, 2, 4, 200])) for _ in range(rng.randrange(50 if trial % 10 else 1500))) * (1 + trial % 3)
        text = np.frombuffer(b, np.uint8)
        order = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix_array.suffix_array(text)
        assert sa.tolist() == order
        plcp = suffix_array.permuted_lcp(text, sa, 12)
        for x, y in zip(order, order[1:], strict=False):
            want = 0
            while want < 12 and x + want < len(b) and y + want < len(b) and b[x + want] == b[y + want]:
                want += 1
            assert plcp[y] == want


def test_anchors_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    raw = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    whole = substring_dedup.anchors(raw)
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    pieces = substring_dedup.anchors(raw)
    assert all(a.tolist() == b.tolist() for a, b in zip(whole, pieces, strict=True))
    begin, size, at, _ = whole
    assert begin[0] == 0 and (begin[1:] == (begin + size)[:-1]).all() and (begin + size)[-1] == len(raw) - 99  # each window in one context
    assert ((at >= begin + size - 1) & (at - begin <= 76)).all()


@pytest.mark.parametrize("parts", [1, 5])
def test_substring_dedup_keeps_repeated_rows(spark, parts):
    rng = random.Random(7)
    base = words(rng, 60)
    rows = [(3, base), (3, base), (None, "n" + base[:150]), (None, "n" + base[:150]), (5, "tail " + base), (6, words(rng, 60)), (6, None)]
    rows[6] = rows[5]
    got = sorted((r.doc_id or -1, r.n_removed, bytes(r.kept)) for r in substring_dedup.remove_repeats(spark, docs_of(spark, rows).repartition(parts)).collect())
    single = brute_cut(dict.fromkeys(rows))
    assert got == sorted((i or -1, single[i][1], single[i][3]) for i, _ in rows)
    assert single[6][1] == 0 and single[None][1] == 0
