"""The registered queries, over whole tables, against brute force."""

from __future__ import annotations

import hashlib
import html.parser
import random
import re

import pytest
from notelens.llm import html_extract, queries
from notelens.sources.tables import table
from tests.llm.test_dedup import brute_cut

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The documents of the smallest tables, with one text of over a million bytes, long repeats of others, and hard rows."""
    rng = random.Random(11)
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    some = [t for _, t in rows if t and len(t) > 400]
    long = "".join(" ".join(str(rng.randrange(10**9)) for _ in range(40)) + (rng.choice(some)[: rng.randint(50, 4000)] if n % 3 == 0 else "") for n in range(2000))
    assert len(long) > 1_000_000
    rows += [(10**6, long), (10**6 + 1, long[500_000:700_000]), (10**6 + 2, None), (10**6 + 3, ""), (None, some[0])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_op1_against_brute_force(spark, folder):
    path, rows = folder
    want = {i: (*r[:3], hashlib.sha256(r[3]).hexdigest()) for i, r in brute_cut(rows).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op1_suffix_dedup(spark, path).collect()}
    assert got == want and sum(r[1] for r in want.values()) > 100_000


def test_op3_against_brute_force(spark, folder):
    """Every document against every item, by the full table of edit distances."""
    from tests.llm.test_pipeline import near_inside

    path, rows = folder
    rows = [r for r in rows if len(r[1] or "") < 20_000]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    table(spark, SMALL, "benchmark").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, path).collect()}
    ids = {i for i, _ in rows}
    assert {x for x in got if x[0] in ids} == {(i, j) for i, t in rows for j, s in items if t and s and near_inside(s, t)}


def test_op4_against_a_plain_scorer(spark):
    """The same model, one document and one passage at a time, in plain Python."""
    import math

    from notelens.llm import quality

    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, SMALL, "labels"))
    w = model.weights

    def plain(text):
        hidden, weight = [], []
        for row in quality.encode((text or "").encode()):
            x = [(float(v) - float(m)) / float(s) for v, m, s in zip(row, model.mean, model.scale, strict=True)]
            h = [math.tanh(sum(a * float(b) for a, b in zip(x, w["E"][:, j], strict=True)) + float(w["e"][j])) for j in range(quality.HIDDEN)]
            gate = lambda k, h=h: [sum(a * float(b) for a, b in zip(h, w[k][:, j], strict=True)) for j in range(quality.GATE)]
            weight.append(math.exp(sum(math.tanh(v) / (1 + math.exp(-u)) * float(c) for v, u, c in zip(gate("V"), gate("U"), w["w"], strict=True))))
            hidden.append(h)
        z = [sum(a * h[j] for a, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(quality.HIDDEN)]
        return 1 / (1 + math.exp(-sum(a * float(c) for a, c in zip(z, w["c"], strict=True)) - float(w["b"][0])))

    texts = {r.doc_id: r.text for r in docs.collect()}
    some = sorted(texts, key=lambda i: (len(texts[i] or "") > 6000, i))[:60]
    scores = {r.doc_id: (r.score, r.predicted) for r in queries.op4_quality(spark, SMALL).collect()}
    assert set(scores) == set(texts)
    for i in some:
        want = plain(texts[i])
        assert abs(scores[i][0] - want) < 1e-3 and scores[i][1] == int(scores[i][0] >= 0.3)


class Reader(html.parser.HTMLParser):
    """An independent reading of the pages: paragraphs, headings and list items of the article that no menu, note,
    sidebar, advert, form or comment section holds."""

    OUT = re.compile(r"(^|[\s_-])(ad|ads|advert|sidebar|menu|nav|navbar|comment|comments|cookie|notice|share|social|related|newsletter|footer|promo|breadcrumb|banner|subscribe|widget)([\s_-]|$)", re.I)
    VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words, self.out = [], [], []

    def bad(self):
        return any(b for _, b in self.open)

    def cut(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "tr", "td", "blockquote", "pre", "nav", "footer", "header", "aside", "form"):
            self.cut()
        if tag in self.VOID:
            self.words.append(" " if tag == "br" else "")
            return
        marks = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        article = any(t in ("article", "main") for t, _ in self.open)
        self.open.append((tag, tag in ("nav", "footer", "aside", "form", "script", "style", "noscript", "head", "title", "button", "select") or (tag == "header" and not article) or bool(self.OUT.search(marks))))

    def handle_endtag(self, tag):
        if tag in ("p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "ul", "ol", "li", "table", "tr", "td", "blockquote", "pre", "nav", "footer", "header", "aside", "form"):
            self.cut()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.bad():
            self.words.append(data)


class Blocks(Reader):
    """The same reading as blocks: text, characters in links, whether boilerplate holds them, whether an article does."""

    SKIP = {"script", "style", "noscript", "template", "textarea", "select", "svg", "math", "iframe", "object", "title", "button", "audio", "video", "canvas"}

    def __init__(self):
        super().__init__()
        self.link = self.linked = self.breaks = 0

    def cut(self):
        text = " ".join("".join(self.words).split())
        if text:
            article = any(t in ("article", "main") for t, _ in self.open)
            self.out.append((text, self.linked, self.bad(), article and not self.bad()))
        self.words, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.cut()
            else:
                self.words.append(" ")
            return
        if tag == "a":
            self.link = 1
        elif tag in html_extract.BLOCK_TAGS:
            self.cut()
            self.link = self.breaks = 0
        if tag in self.SKIP:
            self.words.append(" ")
        if tag in html_extract.CONTAINERS or tag in self.SKIP:
            marks = {w for k, v in attrs if k in ("class", "id") for w in (v or "").split()}
            article = any(t in ("article", "main") for t, _ in self.open)
            self.open.append((tag, tag in ("nav", "footer", "aside", "form", "menu", "dialog") or (tag == "header" and not article) or bool(marks & html_extract.BOILER_WORDS)))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = 0
        elif tag in html_extract.BLOCK_TAGS:
            self.cut()
            self.link = self.breaks = 0
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t in self.SKIP for t, _ in self.open):
            return
        if not data.isspace():
            self.breaks = 0
        self.words.append(data)
        self.linked += len(data.strip()) if self.link else 0


def plain_main_text(page):
    """The two passes as they are stated, each block looking for its neighbours on its own."""
    reader = Blocks()
    reader.feed(page or "")
    reader.close()
    reader.cut()
    labels = []
    for text, linked, bad, article in reader.out:
        dense = [w.strip(".,;:!?%$#&*()\"'|") in html_extract.STOP_WORDS for w in text.lower().split()]
        share = sum(dense) / len(dense)
        if bad or linked * 2 > len(text):
            labels.append("bad")
        elif len(text) >= 70 and share >= 0.15:
            labels.append("good")
        elif len(text) >= 210:
            labels.append("good" if article or share >= 0.05 else "bad")
        else:
            labels.append("short")
    kept = []
    for i, (text, _, _, article) in enumerate(reader.out):
        label = labels[i]
        if label == "short":
            near = [(abs(i - j), labels[j]) for j in range(len(labels)) if labels[j] != "short" and (reader.out[j][3] or not article)]
            best = {x for d, x in near if d == min(near)[0]}
            label = best.pop() if len(best) == 1 else "good" if article else "bad"
        if label == "good":
            kept.append(text)
    return "\n\n".join(kept)


def test_op8_against_plain_block_rules(spark):
    """Every page, character by character, read by another parser and by the rules as stated."""
    pages = {r.page_id: r.html for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    rows = {r.page_id: r for r in queries.op8_html(spark, "/root/testdata/sf0.01").collect()}
    assert set(rows) == set(pages)
    for i, page in pages.items():
        assert rows[i].text == plain_main_text(page), i
        assert rows[i].n_chars == len(rows[i].text)


def test_op9_against_brute_force(spark):
    from tests.llm.test_dedup import brute_components

    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_jaccard_join(spark, SMALL).collect()}
    assert got == brute_components(rows)


def test_op5_against_another_implementation(spark, folder):
    """Ids of every whole text, among them one of over a million characters, as another unigram lattice gives them."""
    from notelens.llm import sentencepiece_codec
    from tokenizers import Tokenizer, models

    pieces, scores, kinds = sentencepiece_codec.load_pieces(queries.PIECES)
    other = Tokenizer(models.Unigram([(p, s) if k != "none" else (f"\x01{i}", -1e9) for i, (p, s, k) in enumerate(zip(pieces, scores, kinds, strict=True))], unk_id=0, byte_fallback=True))
    path, rows = folder
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(other.encode("▁" + t.replace(" ", "▁")).ids if t else [])
    got = queries.op5_sentencepiece(spark, path).collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    scored = lambda ids: sum(scores[i] for i in ids)  # noqa: E731  a tie may be cut another way
    for r in got:
        assert any(list(r.ids) == ids or (len(ids) and abs(scored(r.ids) - scored(ids)) < 1e-6 * len(ids)) for ids in want[r.doc_id]) or not r.ids, r.doc_id


def test_op7_against_brute_force(spark, folder):
    """Every document against every template by its shingles; some documents carry templates, one far into a long text."""
    from notelens.llm import licenses
    from tests.llm.test_text_ops import brute_licenses

    _, rows = folder
    rng = random.Random(3)
    rows = [(i, t) for i, t in rows if i is not None]
    long = max(rows, key=lambda r: len(r[1] or ""))[1]
    for n, (_, wording) in enumerate(licenses.TEMPLATES.items()):
        rows.append((2 * 10**6 + n, f"{rng.choice(rows)[1] or ''} {wording} {rng.choice(rows)[1] or ''}"))
    rows.append((3 * 10**6, long + " " + wording))
    got = licenses.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert {(r.doc_id, r.license, round(r.share, 6)) for r in got.collect()} == brute_licenses(rows, licenses.TEMPLATES)


def test_op7_query_over_its_table(spark):
    from notelens.llm import licenses
    from tests.llm.test_text_ops import brute_licenses

    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    assert {(r.doc_id, r.license, round(r.share, 6)) for r in queries.op7_licenses(spark, SMALL).collect()} == brute_licenses(rows, licenses.TEMPLATES)
