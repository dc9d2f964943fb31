"""WARC, decontamination, SentencePiece, licenses, HTML and chats: edge cases, round trips, brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import tracemalloc

import pytest
from notelens.llm import chat_format, decontaminate, html_extract, licenses, sentencepiece_codec, warc

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/x", "<p>é</p>"), (1, "http://b\r\n/y", "<p>é</p>"), (2, None, None), (5, "u", ""), (4, "u", "other"), (None, "u", "other"), (1, "again", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archive(pages, path)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert len(body) == int(re.search(rb"Content-Length: (\d+)", head)[1])
        payload = next((t or "") for i, u, t in rows if i == r.page_id)
        assert r.payload_bytes == len(payload.encode())
        assert r.payload_digest == r.header_digest == base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        if r.record_type == "response":
            assert body.endswith(b"\r\n\r\n" + payload.encode())
    kinds = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to) for r in got)
    assert kinds == [(-1, "revisit", 4), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "revisit", 2)]
    assert spark.read.parquet(f"{path}/payloads").count() == 3


def test_warc_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/w", min_bytes=3)
    assert sorted((r.page_id, r.refers_to) for r in warc.read_archive(spark, f"file://{tmp_path}/w").collect()) == [(1, None), (2, None), (3, None), (4, 3)]


def test_warc_damage_is_seen(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab")], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/w")
    spark.read.parquet(f"file://{tmp_path}/w/payloads").selectExpr("digest", "cast('xx' as binary) payload").write.parquet(f"file://{tmp_path}/v/payloads")
    spark.read.parquet(f"file://{tmp_path}/w/headers").write.parquet(f"file://{tmp_path}/v/headers")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, f"file://{tmp_path}/v").select("payload_bytes").collect()


def test_warc_export_is_a_warc_file(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab")], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/w")
    warc.export_records(warc.read_archive(spark, f"file://{tmp_path}/w"), f"file://{tmp_path}/out")
    text = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part")).read_bytes()
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"ab\r\n\r\n")


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: " ".join("".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, make(12)) for i in range(6)] + [(7, ""), (8, None), (9, "tiny"), (3, make(9))]
    rows = [(1, None), (2, ""), (3, "it has a tiny word")]
    for i in range(10, 60):
        text = make(20)
        if i % 2:
            s = list(rng.choice(items[:6])[1])
            for _ in range(rng.randint(0, 10)):
                p = rng.randrange(len(s))
                s[p : p + 1] = rng.choice([[], ["q"], ["q", s[p]]])
            text = text[:40] + "".join(s).upper().replace(" ", "\n", 1) + text[40:]
        rows.append((i, text))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    for block in (10_000, 50):
        got = {}
        for r in decontaminate.find_contamination(spark, docs, bench, block_chars=block).collect():
            got.setdefault((r.doc_id, r.item_id), []).append(r.edits)
        want = {}
        plain = lambda t: re.sub(r"[\t-\r]", " ", t).lower()
        for d, t in rows:
            for i, s in items:
                if s and t:
                    m = len(s)
                    budget = max(0, min(int(m * 0.1), (m - 8) // 8))
                    edits = edit_distance_inside(plain(s), plain(t))
                    if edits <= budget:
                        want.setdefault((d, i), []).append(edits)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    kept = decontaminate.drop_contaminated(spark, docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.find_contamination(spark, docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(spark, docs.limit(0), bench).count() == 0


def test_decontamination_of_repetitive_texts_is_bounded():
    items = [(i, " " * 60 + f"item {i}") for i in range(400)]
    index = decontaminate.Index(items)
    tracemalloc.start()
    found = index.matches(" " * 4000 + "item 7 " + "x " * 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (7, 4000 - 60, 4000 + 6, 0) in found and peak < 400e6


def test_decontamination_in_parts_finds_the_same(monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(2, 5)))
    items = [(i, "".join(word() for _ in range(rng.choice([3, 10, 40])))) for i in range(12)]
    index = decontaminate.Index(items)
    for trial in range(25):
        s = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(len(s))] = rng.choice("ab c")
        text = "".join(word() for _ in range(60)) + "".join(s) + "".join(word() for _ in range(60))
        monkeypatch.setattr(decontaminate, "PAIRS", 1 << 40)
        monkeypatch.setattr(decontaminate, "WINDOW", 1 << 20)
        want = index.matches(text)
        regions = index.regions(decontaminate.codes(text)).tolist()
        for pairs in (1, 50, 3000):
            monkeypatch.setattr(decontaminate, "PAIRS", pairs)
            assert sorted(index.regions(decontaminate.codes(text)).tolist()) == sorted(regions)
            assert index.matches(text) == want
        monkeypatch.setattr(decontaminate, "WINDOW", 64)
        assert index.matches(text) == want
        plain = text.lower()
        assert {i for i, *_ in want} == {i for i, t in items if edit_distance_inside(t, plain) <= max(0, min(int(len(t) * 0.1), (len(t) - 8) // 8))}


def test_long_items_are_aligned_in_a_band():
    rng = random.Random(9)
    item = "".join(rng.choice("abcdefghij ") for _ in range(8000))
    s = list(item)
    for p in sorted(rng.sample(range(8000), 300), reverse=True):
        s[p : p + 1] = rng.choice([[], ["z"], ["z", s[p]]])
    index = decontaminate.Index([(1, item)])
    text = "before " * 30 + "".join(s) + " after" * 30
    began = time.process_time()
    found = index.matches(text)
    assert time.process_time() - began < 2 and len(found) == 1 and 0 < found[0][3] <= 300
    assert abs(found[0][1] - 210) < 20


def test_sentencepiece_round_trip_and_best_path(spark):
    texts = [None, "", " ", "  two  spaces ", "▁mark ▁", "line\n\n break\t", "é€𝄞\x00<s> </s> <0x41>", "word " * 20000, "The quick brown fox, der Fuß, l'été.", "word", "word"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    rows = sentencepiece_codec.encode(spark, docs, PIECES, decoded=True).collect()
    assert {r.doc_id: r.decoded for r in rows} == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.n_tokens == len(r.ids) for r in rows)
    again = sentencepiece_codec.decode(spark, sentencepiece_codec.encode(spark, docs.drop("ids"), PIECES), PIECES)
    assert {r.doc_id: r.decoded for r in again.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert sentencepiece_codec.encode(spark, docs.limit(0), PIECES).count() == 0


def test_sentencepiece_path_is_the_best(spark):
    from tokenizers import Tokenizer, models

    pieces, scores, kinds = sentencepiece_codec.load_pieces(PIECES)
    codec = sentencepiece_codec.Codec(pieces, scores, kinds)
    other = Tokenizer(models.Unigram([(p, s) if k != "none" else (f"\x01{i}", -1e9) for i, (p, s, k) in enumerate(zip(pieces, scores, kinds, strict=True))], unk_id=0, byte_fallback=True))
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abcdeinorst  \néß,.") for _ in range(rng.randint(1, 60)))
        assert codec.encode(text) == other.encode("▁" + text.replace(" ", "▁")).ids


def test_best_path_by_brute_force():
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "▁a"] + [f"<0x{i:02X}>" for i in range(256)]
    scores = [-1.0, -1.5, -1.2, -2.0, -2.1, -3.4, -1.9] + [0.0] * 256
    codec = sentencepiece_codec.Codec(pieces, scores, ["normal"] * 7 + ["byte"] * 256)

    def best(s):
        if not s:
            return 0.0
        fits = [scores[i] + best(s[len(p) :]) for i, p in enumerate(pieces[:7]) if s.startswith(p)]
        return max(fits) if any(s[0] == p for p in pieces[:7]) else max([*fits, min(scores[:7]) - 10 + best(s[1:])])

    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 9)))
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        spelt = sum(scores[i] if i < 7 else min(scores[:7]) - 10 for i in ids)
        assert spelt == pytest.approx(best("▁" + text.replace(" ", "▁")))


def brute_licenses(rows, templates):
    words = lambda t: [w for w in re.sub(r"[\W_]+", " ", (t or "").lower()).split(" ") if w]
    want = set()
    for i, t in rows:
        w = words(t)
        for name, text in templates.items():
            v = words(text)
            n = min(5, len(v))
            wanted = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            size = 2 * 2 ** math.ceil(math.log2(len(wanted)))
            h = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
            best = max((len(wanted & set(h[a : a + size])) / len(wanted) for a in range(0, max(1, len(h)), size // 2)), default=0)
            if best >= 0.8:
                want.add((i, name, round(best, 6)))
    return want


def test_licenses(spark):
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "the", "of", "license", "copy"]) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "All rights reserved"), (4, "one two"), (5, "Permission")]
    for i, (_, text) in enumerate(licenses.TEMPLATES.items(), 10):
        w = text.upper().split() if i % 2 else text.split()
        if len(w) > 60:
            w[30] = "changed"
        rows += [(i, filler(rng.randint(0, 400)) + "\n" + " ".join(w) + "\n" + filler(50)), (100 + i, " ".join(w[: len(w) // 2]))]
    rows.append((10, rows[5][1]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string").repartition(3)
    got = licenses.scan_licenses(spark, docs).collect()
    assert {(r.doc_id, r.license, round(r.share, 6)) for r in got} == brute_licenses(rows, licenses.TEMPLATES)
    assert len(got) == len({(r.doc_id, r.license) for r in got})
    assert licenses.scan_licenses(spark, docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="menu-open">
<nav><ul><li><a href="/a">Home of the news</a></li></ul></nav><header>Site of the day</header><div class="ad">Buy the best of the best.</div>
<div class="cookie-notice"><p>We use cookies, and it is for the best of you that we do so on this page.</p></div>
<article><header><h1>Title &amp; more</h1></header><p><b>First<br>line &copy; it is<p>Short.</p><aside>Aside of the day</aside>
<div>Loose   text&nbsp;here</div><p>%s</p></article><form><p>Sign up for the news</p></form>
<section id="comments"><p>I think that the text is good, and that it was written by one of the best.</p></section><footer>&copy; it</footer>"""


def test_html(spark):
    long = "The text of this is long and it has all the words that are in the language of the day for you."
    full = PAGE % long
    pages = [(1, full), (2, None), (3, ""), (4, "plain text of the page that is not in any tag but is long and has many of the words"), (5, full[: full.index("Loose")]), (6, "<p>" + "word the of " * 50000), (6, "<a <b <"), (7, "<article>Only.</article>")]
    frame = spark.createDataFrame([(i, "u", t, "x") for i, t in pages], "page_id long, url string, html string, text string").repartition(3)
    got = {}
    for r in html_extract.extract(frame).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == ["\n\n".join(["Title & more", "First line © it is", "Short.", "Loose text here", long])]
    assert got[2] == got[3] == [""]
    assert got[4] == [pages[3][1]]
    assert got[5] == ["Title & more\n\nFirst line © it is\n\nShort."]
    assert len(max(got[6], key=len)) == len("word the of " * 50000) - 1
    assert got[7] == ["Only."]


def test_html_short_blocks_inherit():
    a, b = html_extract.GOOD, html_extract.BAD
    s = html_extract.SHORT
    assert html_extract.second_pass([a, s, a, s, s, b, s, b], [False] * 8) == [True, True, True, True, False, False, False, False]
    assert html_extract.second_pass([s, s], [True, False]) == [True, False]


def test_chats(spark):
    rng = random.Random(8)
    pieces = ["\\", "#", "###", "### ", "</turn>", "<turn>", "\n", ":", ": ", "\\h", "\\l", "a", "é", ""]
    turns = [(1, 1, "user", "x"), (1, 0, "user", "first"), (1, 2, "assistant", None), (1, 2, "assistant", None), (2, None, None, None), (3, 1, "a:b\n### c", "t"), (None, 0, "user", "no id"), (5, 0, "assistant", "y" * 200_000)]
    for c in range(10, 60):
        turns += [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for t in range(rng.randint(1, 6))]
    frame = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, turns string").repartition(3)
    got = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(frame)).collect()}
    want = {}
    for c, t, role, text in turns:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(want)
    for c, rows in want.items():
        rows.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [r[2:] for r in rows]
        assert got[c].loss_text == "".join(r[3] for r in rows if r[2] == "assistant")
        runs = [r[2] for k, r in enumerate(rows) if not k or rows[k - 1][2] != r[2]]
        assert [r.role for r in got[c].runs] == runs
        assert got[c].formatted.count("### ") == len(runs) and got[c].formatted.count("</turn>") == len(rows)
    assert chat_format.format_chats(frame.limit(0)).count() == 0


STORY = " ".join(["This is the story that the page was made for, and it is long enough to be read as one."] * 4)
AD = " ".join(["Buy it now from us and get the second one for free, this is an offer that ends at the end of the day."] * 3)


@pytest.mark.parametrize("page", [
    '<div class="page no-sidebar"><article><p>{}</p></article></div>', '<div class="has-menu"><article><p>{}</p></article></div>', '<div class="content search-results"><p>{}</p></div>',
    '<div class="post share-buttons-on"><p>{}</p></div>', '<form id="aspnet"><div><article><p>{}</p></article></div></form>', "<nav><a href=x>Home</a><article><p>{}</p></article>",
    '<form id="aspnet"><p>{}</p></form>', '<div class="modal"><article><p>{}</p></article></div>', '<div id="sidebar"><p>{}</p></div>', "<nav><ul><li><a href=x>Home</a><main><p>{}</p></main>",
])
def test_html_loses_no_main_text(page):
    assert html_extract.main_text(f"<html><body>{page.format(STORY)}<footer>Imprint</footer></body></html>") == STORY


@pytest.mark.parametrize("other", [
    '<div class="site-footer"><p>{}</p></div>', '<div class="ad"><p>{}</p></div>', '<section class="comments"><article><p>{}</p></article></section>', '<div class="cookie-banner x"><p>{}</p></div>',
    "<aside><article><p>{}</p></article></aside>", '<form class="a"><p>{}</p></form>', '<div role="complementary"><p>{}</p></div>', '<div id="main_nav"><p>{}</p></div>', "<nav><p>{}</p></nav>", '<div hidden><p>{}</p></div>',
])
def test_html_leaves_out_what_is_no_article(other):
    for page in ("<article><p>{}</p></article>" + other, other + "<article><p>{}</p></article>"):
        texts = [STORY, AD] if page.startswith("<article>") else [AD, STORY]
        assert html_extract.main_text(page.format(*texts)) == STORY


def test_html_stray_and_unclosed_tags_take_linear_time():
    started = time.monotonic()
    assert html_extract.main_text("<div>" * 60_000 + "</section>" * 60_000 + f"<p>{STORY}") == STORY
    assert html_extract.main_text('<div class="ad">' * 20_000 + "<nav>" * 20_000 + "<article>" * 200 + f"<p>{STORY}") == STORY
    assert time.monotonic() - started < 5


def nearest_parts(item, text, k):
    """(edits, start, end) for every start by the full table: the least of them, by edits, start and end."""
    best = None
    for start in range(len(text) + 1):
        row = list(range(len(item) + 1))  # row[j]: distance of item[:j] to text[start:end]
        for end in range(start, len(text) + 1):
            if end > start:
                new = [end - start]
                for j, c in enumerate(item, 1):
                    new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != text[end - 1])))
                row = new
            if row[-1] <= k and (best is None or (row[-1], start, end) < best):
                best = (row[-1], start, end)
    return best


def test_alignment_of_ties_is_earliest():
    code = lambda t: decontaminate.codes(t)
    assert decontaminate.align(code("abcdef"), code("zzzzz?bcdefzz"), 1) == (1, 5, 11)
    rng = random.Random(4)
    for _ in range(150):
        item = "".join(rng.choice("ab") for _ in range(rng.randint(4, 9)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 24)))
        for k in (0, 1, 2):
            assert decontaminate.align(code(item), code(text), k, -k, len(text) + len(item) + 1 + k) == nearest_parts(item, text, k), (item, text, k)


def test_contamination_spans_of_ties(spark):
    """Items with edits, several times in a text, some across windows: the span is the earliest of the fewest edits."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(6)]

    def bent(t):
        at = rng.randrange(len(t))
        return rng.choice([t[:at] + "?" + t[at + 1 :], t[:at] + t[at + 1 :], t[:at] + "?" + t[at:], t, "?" + t[1:]])

    docs = []
    for d in range(12):
        _, t = items[d % 6]
        docs.append((d, " ".join([word() for _ in range(rng.randint(0, 9))] + [bent(t)] + [word() for _ in range(5)] + [bent(bent(t))])))
    docs += [(None, docs[0][1]), (77, docs[0][1]), (78, "")]
    got = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in decontaminate.find_contamination(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        for i, t in items:
            k = max(0, min(int(len(t) * decontaminate.RATE), (len(t) - decontaminate.Q) // decontaminate.Q))
            if found := nearest_parts(t, text, k):
                want[d, i] = found
    assert got == want and len(want) >= 13
