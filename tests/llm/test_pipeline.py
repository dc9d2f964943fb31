"""Quality model and pipeline: held-out accuracy, edge cases, and the pipeline against plain Python."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline
import numpy as np
from notelens.llm import decontaminate, quality, queries, sentencepiece_codec
from notelens.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_quality_held_out_accuracy(spark):
    rows = queries.op4_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "a b " * 40000, "s"), (4, "x", "s"), (4, "x", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality.train(docs, labels) is None
    assert {r.score for r in quality.with_score(docs, None).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    scored = quality.with_score(docs, quality.train(docs, some)).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    assert quality.with_score(docs.limit(0), None).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(k, quality.WIDTH)).astype(np.float32) for k in (1, 3, 2, 5) * 10]
    labels = np.array([float(b[:, 0].max() > 0.5) for b in bags])
    model = quality.fit(bags, labels, epochs=200)
    assert ((model.score(bags) > 0.5) == labels).mean() > 0.95
    weights = model.forward(((np.concatenate(bags) - model.mean) / model.scale), np.cumsum([0, *map(len, bags)])[:-1], np.repeat(np.arange(40), [len(b) for b in bags]))["a"]
    assert np.allclose(np.add.reduceat(weights, np.cumsum([0, *map(len, bags)])[:-1]), 1, atol=1e-5)


def plain_stages(rows, labels, items):
    """What each stage keeps of rows (doc_id, text), in plain Python: doc ids by stage, and the ids of the tokens."""
    out = []
    chosen = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5}
    known = [(i, quality.encode((t or "").encode()).astype(np.float16).astype(np.float32), y) for i, t in rows for j, y in labels if i == j and i in chosen]
    known.sort(key=lambda x: x[0])
    model = quality.fit([x for _, x, _ in known], np.array([y for _, _, y in known]))
    rows = [(i, t) for i, t in rows if model.score([quality.encode((t or "").encode())])[0] >= 0.3]
    out.append({i for i, _ in rows})
    last = {}
    for i, t in rows:
        last[t or ""] = max(i, last.get(t or "", i))
    rows = [(i, t) for i, t in rows if last[t or ""] == i]
    out.append({i for i, _ in rows})
    comp = near_components(rows)
    rows = [(i, t) for i, t in rows if comp[i] == i]
    out.append({i for i, _ in rows})
    rows = [(i, t) for i, t in rows if not any(near_inside(s, t or "") for s in items if s)]
    out.append({i for i, _ in rows})
    return out, dict(rows)


def near_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower() if (t or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, sa in sets.items():
        for b, sb in sets.items():
            if a < b and sa and sb and 100 * len(sa & sb) >= 90 * len(sa | sb):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: root(i) for i in sets}


def near_inside(item, text):
    """Whether an item occurs within its budget of edits, by the full table of edit distances."""
    def plain(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"[\t-\r]", " ", t))

    a, b = np.frombuffer(plain(item).encode("utf-32-le"), np.uint32), np.frombuffer(plain(text).encode("utf-32-le"), np.uint32)
    q = decontaminate.Q
    k = max(0, min(int(len(a) * decontaminate.RATE), (len(a) - q) // q))
    row, steps = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    for c in a.tolist():
        new = np.minimum(row + 1, np.concatenate([[row[0] + 1], row[:-1] + (b != c)]))
        row = np.minimum.accumulate(new - steps) + steps
    return row.min() <= k


def test_whole_pipeline_against_plain_python(spark, tmp_path):
    """run() and each stage on whole tables, against a brute-force version of all five."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    labels = sorted((r.doc_id, r.quality) for r in table(spark, sf, "labels").collect())
    kept, left = plain_stages(sorted(texts.items()), labels, [r.text for r in table(spark, sf, "benchmark").collect()])
    docs = table(spark, sf, "documents")
    for (_, stage), want in zip(corpus_pipeline.STAGES[:4], kept, strict=True):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"file://{tmp_path}/{len(want)}-{stage.__name__}")
        docs = spark.read.parquet(f"file://{tmp_path}/{len(want)}-{stage.__name__}")
        assert {r.doc_id for r in docs.collect()} == want and docs.columns == table(spark, sf, "documents").columns
    assert set(texts) > kept[0] >= kept[1] >= kept[2] >= kept[3] and kept[0] > kept[3]
    codec = sentencepiece_codec.Codec(*sentencepiece_codec.load_pieces(corpus_pipeline.PIECES))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: codec.encode(t or "") for i, t in left.items()} and len(rows) == len(left)
    assert all(codec.decode(r.ids) == left[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "some words of a text", "a", "b", "c"), (2, None, "a", "b", "c"), (3, "some words of a text", "a", "b", "c"), (None, "w " * 90, "a", "b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha256 string, _score string, component_id string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        for found in (stage(spark, docs, SF), stage(spark, docs.limit(0), SF)):
            assert found.schema.simpleString() == docs.schema.simpleString()
            assert {tuple(r)[2:] for r in found.collect()} <= {("a", "b", "c")}


def test_exact_stage_with_null_ids_and_repeated_rows(spark):
    rows = [(None, "a"), (None, "b"), (5, "a"), (5, "a"), (6, "c"), (6, "d"), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.exact_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == [(0, "b"), (5, "a"), (6, "c"), (6, "d"), (8, "")]
    assert corpus_pipeline.near_copies(spark, docs, SF).count() == 8 and corpus_pipeline.exact_copies(spark, docs.limit(0), SF).count() == 0
