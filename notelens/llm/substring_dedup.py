"""Suffix-array deduplication of repeated byte strings.

Every byte that lies in a string of ``length`` bytes which also starts earlier (in a document of smaller
id, or earlier in the same document) is removed; strings are judged on the texts as they came.

1. Anchors. Among the q-grams of each window of ``length`` bytes the one of least hash (the leftmost, if
   several) is its anchor, and neighbouring windows of one anchor are its context. Equal windows have
   equal anchors at equal places, so each window needs to be held against the contexts of its anchor
   alone, and stands in one context only. Contexts are some 2.6 % of the bytes in number; each travels
   as a hash.
2. Contexts. Sorted by anchor, context and place, rows pass once: a context that came before is removed
   whole. Only anchors with several different contexts, where a repeated region begins or ends, need a
   comparison of bytes.
3. Shard arrays. The bytes of the different contexts of one anchor meet in one shard. A context that
   agrees with no other round the anchor as far as a common window would is left out. Each shard builds
   a suffix array by induced sorting and permuted common prefixes; runs of suffixes that agree in
   ``length`` bytes are equal windows, of which the earliest stays.
4. Removal. Intervals are gathered for each document and cut from its text.

An anchor with more contexts than ``SHARD_CONTEXTS`` gives way to longer ones: its contexts are cut into
pieces of ten windows, which go to shards by the 91 bytes that all these windows hold, and where such a
core is as frequent, into pieces of three windows with a core of 98 bytes. What is as frequent even
then is dealt over several shards at random. Each sorts its part in the same way; the
earliest window of each run of a shard then meets those of the other shards by its 128-bit digest, in a
sum that merges before the shuffle, and in a join. So no anchor is gathered whole, however frequent.
Texts travel compressed. Anchor and context hashes have 64 bits each
and count only together.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing; a row without id is
neither smaller nor greater than another, so it stays whole and takes nothing from others; repeated rows
of one id are one place, so they lose the same and take nothing from each other; a very long text is read
whole, piece by piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.llm.suffix_array import permuted_lcp, suffix_array
from notelens.llm.workers import small_batches
from notelens.sources.tables import Scratch, staged

U = np.uint64
LENGTH, GRAM = 100, 24
SHARD_BYTES, PART_BYTES = 1_000_000, 100_000  # of a shard; of one that holds parts of anchors, where each byte may give a row
SHARD_CONTEXTS = 5_000  # of one anchor; with more of them it is dealt over several shards
CORE_STEP, FINE_STEP = 10, 3  # so many neighbouring windows share a core of 91 or 98 bytes
PIECE = 1 << 22  # anchors of longer texts are found piece by piece
BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, q: int = GRAM) -> np.ndarray:
    """Hash of each run of q bytes, from runs of 1, 2, 4 and so on."""
    n = len(raw) - q + 1
    run, size = raw.astype(U) + U(1), 1
    total, covered = None, 0
    while True:
        if q & size:
            total = run[:n].copy() if total is None else total * U(pow(BASE, size, 1 << 64)) + run[covered : covered + n]
            covered += size
        if covered == q:
            break
        run = run[:-size] * U(pow(BASE, size, 1 << 64)) + run[size:]
        size *= 2
    total ^= total >> U(31)
    total *= U(0xBF58476D1CE4E5B9)
    return total ^ (total >> U(29))


def anchors(raw: np.ndarray, length: int = LENGTH, q: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, place of the anchor, its hash) of the context of each anchor, in order."""
    if len(raw) < length:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, U))
    w, firsts, places, hashes = length - q + 1, [], [], []
    windows = len(raw) - length + 1
    for first in range(0, windows, PIECE):
        h = gram_hashes(raw[first : first + PIECE + length - 1], q)
        n = len(h)
        key = (h & ~U(0x7FFFFF)) | np.arange(n).astype(U)
        blocks = np.concatenate([key, np.full(-n % w, ~U(0), U)]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & U(0x7FFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        firsts.append(begin + first)
        places.append(least[begin] + first)
        hashes.append(h[least[begin]])
    begin, at, h = np.concatenate(firsts), np.concatenate(places), np.concatenate(hashes)
    new = np.concatenate([[True], at[1:] != at[:-1]])  # a context may go on in the next piece
    begin = begin[new]
    return begin, np.diff(np.append(begin, windows)), at[new], h[new]


SPAN = 1 << 7  # windows of a context and the anchor's place in it, both below this, in one number


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts with their hashes. Of equal contexts in one batch all but the first are copies already;
    they need no other row, so they are dealt out by their place and cannot crowd an anchor's partition."""
    for whole in batches:
        for first in range(0, whole.num_rows, 1000):
            batch = whole.slice(first, 1000)
            ids, found = [], []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = data or b""
                begin, size, at, h = anchors(np.frombuffer(data, np.uint8))
                if len(at):
                    digest = b"".join([hashlib.blake2b(data[s:e], digest_size=8).digest() for s, e in zip(begin.tolist(), (begin + size + LENGTH - 1).tolist(), strict=True)])
                    found.append((h.view(np.int64), np.frombuffer(digest, np.int64), begin.astype(np.int32), (size * SPAN + at - begin).astype(np.int16)))
                    ids.append(np.full(len(at), i, np.int64))
            anchor, ctx, at, span = (np.concatenate([*(f[j] for f in found), np.zeros(0, kind)]) for j, kind in enumerate((np.int64, np.int64, np.int32, np.int16)))
            doc = np.concatenate([*ids, np.zeros(0, np.int64)])
            order = np.lexsort((at, doc, ctx, anchor))
            anchor, ctx, doc, at, span = anchor[order], ctx[order], doc[order], at[order], span[order]
            copy = np.concatenate([np.zeros(min(1, len(at)), bool), (anchor[1:] == anchor[:-1]) & (ctx[1:] == ctx[:-1])])
            first_of = np.maximum.accumulate(np.where(copy, 0, np.arange(len(at))))
            kept = ~(copy & (doc == doc[first_of]) & (at == at[first_of]))  # a repeated row stands in the same place
            anchor, ctx, doc, at, span, copy = anchor[kept], ctx[kept], doc[kept], at[kept], span[kept], copy[kept]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, ctx, doc, at, span, copy)], ["anchor", "ctx", "doc_id", "at", "span", "copy"])


MARKS = ["anchor", "doc_id", "at", "span"]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, context, document and place: copies of a context (copy), and the first row
    of each context of an anchor that has several. Rows known as copies pass as they are.
    Holds one batch and one row."""
    held = None  # first row of the last context, while its anchor has no other
    last = None  # (anchor, ctx) of the last row, and (document, place) of the first row of its context
    for mixed in batches:
        known = mixed.filter(mixed.column("copy"))
        if known.num_rows:
            yield known.select([*MARKS, "copy"])
        batch = mixed.filter(pc.invert(mixed.column("copy"))) if known.num_rows else mixed
        if not batch.num_rows:
            continue
        anchor, ctx = batch.column("anchor").to_numpy(), batch.column("ctx").to_numpy()
        same_anchor = np.concatenate([[last is not None and anchor[0] == last[0]], anchor[1:] == anchor[:-1]])
        copy = same_anchor & np.concatenate([[last is not None and ctx[0] == last[1]], ctx[1:] == ctx[:-1]])
        doc, at = batch.column("doc_id").to_numpy(), batch.column("at").to_numpy()
        first_of = np.maximum.accumulate(np.where(copy, -1, np.arange(len(at))))  # -1: in an earlier batch
        first_doc, first_at = np.where(first_of < 0, last[2] if last else 0, doc[first_of]), np.where(first_of < 0, last[3] if last else 0, at[first_of])
        firsts = np.flatnonzero(~copy)  # first row of each context
        copy &= (doc != first_doc) | (at != first_at)  # a repeated row stands in the same place
        later = same_anchor[firsts]  # its anchor has an earlier context
        with_next = np.concatenate([later[1:], [False]])
        rows, kinds = [batch.filter(pa.array(copy))], [np.ones(int(copy.sum()), bool)]
        if held is not None and len(firsts):
            if later[0]:
                rows.append(held)
                kinds.append(np.zeros(1, bool))
            held = None
        chosen = firsts[later | with_next]
        rows.append(batch.take(pa.array(chosen)))
        kinds.append(np.zeros(len(chosen), bool))
        if len(firsts) and not later[-1]:
            held = batch.slice(int(firsts[-1]), 1)
        last = (anchor[-1], ctx[-1], first_doc[-1], first_at[-1])
        out = pa.Table.from_batches(rows).select(MARKS).append_column("copy", pa.array(np.concatenate(kinds)))
        yield from out.combine_chunks().to_batches()


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([press.compress(t or b"") for t in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["doc_id", "packed"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts, and where the anchor stands in them."""
    for whole in batches:
        for first in range(0, whole.num_rows, 50):
            batch, out = whole.slice(first, 50), []
            for i, packed, places in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                data = zstandard.decompress(packed)
                out += [(p["anchor"], i, p["at"], p["span"] % SPAN, data[p["at"] : p["at"] + p["span"] // SPAN + LENGTH - 1]) for p in places]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["anchor", "doc_id", "start", "within", "bytes"])


CONTEXTS = "anchor long, doc_id long, start int, within short, bytes binary"


def cores(within: int, data: bytes, step: int) -> Iterator[tuple[int, bytes, int, int]]:
    """The windows of a context by where they begin before the anchor, so many at a time: (which, their core: the bytes
    that all of them hold, first and last window). Equal windows are equal in which they are, and in the core."""
    last = len(data) - LENGTH
    for b in range(0, LENGTH - GRAM + 1, step):
        low, high = max(0, within - b - step + 1), min(last, within - b)
        if low <= high:
            yield b, data[within - b : within - b - step + 1 + LENGTH], low, high


def with_common_cores(contexts: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Of the contexts (document, start, place of the anchor, bytes) of one anchor those that may share a window with
    another, as they have a core in common, cut to the windows from the first such core to the last."""
    seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    span: dict[int, tuple[int, int]] = {}
    for j, (_, _, within, data) in enumerate(contexts):
        for b, core, low, high in cores(within, data, CORE_STEP):
            other = seen.setdefault((b, core), (j, low, high))
            if other[0] != j:
                for k, first, last in (other, (j, low, high)):
                    known = span.get(k, (first, last))
                    span[k] = min(first, known[0]), max(last, known[1])
    return [(contexts[j][0], contexts[j][1] + low, contexts[j][3][low : high + LENGTH]) for j, (low, high) in sorted(span.items())]


def window_classes(parts: list[tuple[int, int, bytes]], length: int = LENGTH) -> tuple[list[tuple[int, int, int]], list[tuple[bytes, int, int]]]:
    """By one suffix array over all the parts (document, start, bytes): (document, first byte, end) of runs of
    windows that stand earlier among the parts too, and (bytes, document, first byte) of the others."""
    sizes = np.array([len(p[2]) for p in parts], np.int64)
    whole = b"".join(p[2] for p in parts)
    text = np.frombuffer(whole, np.uint8)
    if not len(text):
        return [], []
    sa = suffix_array(text)
    plcp = permuted_lcp(text, sa, length)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(parts)), sizes)
    inside = ends[owner] - np.arange(len(text)) >= length
    ids = np.array([p[0] for p in parts], np.int64)
    names, rank = np.unique(ids, return_inverse=True)
    place = np.array([p[1] for p in parts], np.int64)[owner] + np.arange(len(text)) - (ends - sizes)[owner]
    key = (rank.astype(np.int64)[owner] << 36) + place
    never = np.iinfo(np.int64).max
    ordered = np.where(inside, key, never)[sa]
    begins = np.flatnonzero(np.concatenate([[True], plcp[sa[1:]] < length]))
    earliest = np.minimum.reduceat(ordered, begins)
    earliest = np.repeat(earliest, np.diff(np.append(begins, len(sa))))
    document, byte = lambda k: int(names[k >> 36]), lambda k: k & (1 << 36) - 1
    gone, runs = np.unique(ordered[(ordered != never) & (ordered > earliest)]), []
    if len(gone):
        breaks = np.concatenate([[True], np.diff(gone) > length])
        first, last = gone[breaks], gone[np.concatenate([np.flatnonzero(breaks)[1:] - 1, [len(gone) - 1]])]
        runs = [(document(a), byte(a), byte(b) + length) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    stay = (ordered != never) & (ordered == earliest)
    firsts = [(whole[at : at + length], document(k), byte(k)) for at, k in zip(sa[stay].tolist(), ordered[stay].tolist(), strict=True)]
    return runs, firsts


def _pieces(step: int):
    """Contexts cut so that each window stands in one piece, with a hash of its core in place of the anchor: the core
    is a longer anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                out = []
                for _, i, start, within, data in zip(*(whole.slice(first, 1000).column(j).to_pylist() for j in range(5)), strict=True):
                    for b, core, low, high in cores(within, data, step):
                        key = int.from_bytes(hashlib.blake2b(bytes([b]) + core, digest_size=8).digest(), "little", signed=True)
                        out.append((key, i, start + low, within - low, data[low : high + LENGTH]))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["anchor", "doc_id", "start", "within", "bytes"])

    return run


def _runs_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64() if not j else pa.int32()) for j in range(3)], ["doc_id", "s", "e"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs by shards of whole anchors; rows come sorted by anchor."""
    parts: list[tuple[int, int, bytes]] = []
    one: list[tuple[int, int, int, bytes]] = []  # contexts of the present anchor
    size, last = 0, None
    for batch in batches:
        for anchor, *context in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
            if anchor != last and one:
                new = with_common_cores(one)
                size += sum(len(p[2]) for p in new)
                parts += new
                one = []
                if size >= SHARD_BYTES:
                    yield _runs_batch(window_classes(parts)[0])
                    parts, size = [], 0
            one.append(tuple(context))
            last = anchor
    parts += with_common_cores(one)
    if parts:
        yield _runs_batch(window_classes(parts)[0])


def _part_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs within shards that hold parts of anchors (without digest), and the other windows, which may
    repeat those of another shard, by digest."""
    def done(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        runs, firsts = window_classes(parts)
        rows = [(None, *r) for r in runs] + [(hashlib.blake2b(w, digest_size=16).digest(), i, s, s + LENGTH) for w, i, s in firsts]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.int32()))], ["digest", "doc_id", "s", "e"])

    parts, size = [], 0
    for batch in batches:
        for _, i, start, _, data in zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True):
            parts.append((i, start, data))
            size += len(data)
            if size >= PART_BYTES:
                yield done(parts)
                parts, size = [], 0
    if parts:
        yield done(parts)


def _across(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """Repeated runs (doc_id, s, e) of pieces of cores that stay frequent, none of which is gathered."""
    spread = pieces.repartition(F.xxhash64("doc_id", "start"))
    found = scratch.staged(spread.mapInArrow(_part_shards, "digest binary, doc_id long, s int, e int"), "windows")
    windows = found.filter("digest is not null")
    first = windows.groupBy("digest").agg(F.min(F.struct("doc_id", "s")).alias("first"))
    across = windows.join(scratch.staged(first, "firsts"), "digest").filter(F.struct("doc_id", "s") > F.col("first"))
    return found.filter("digest is null").unionByName(across.select(found.columns)).drop("digest")


def cut(data: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs); spans: first byte << 32 | end, in any order."""
    if not len(spans):
        return data, 0, 0
    spans = np.sort(spans)
    s, e = np.minimum(spans >> 32, len(data)), np.maximum.accumulate(np.minimum(spans & 0xFFFFFFFF, len(data)))
    breaks = np.flatnonzero(s[1:] > e[:-1]) + 1
    first, end = s[np.concatenate([[0], breaks])], e[np.concatenate([breaks - 1, [len(e) - 1]])]
    some = end > first
    first, end = first[some], end[some]
    kept = b"".join([data[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(data)], strict=True)])
    return kept, int((end - first).sum()), len(first)


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    for whole in batches:
        for first in range(0, whole.num_rows, 200):
            batch, out = whole.slice(first, 200), []
            spans = batch.column(2)
            for j, (i, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                data = zstandard.decompress(packed)
                kept, removed, runs = cut(data, spans[j].values.to_numpy() if spans[j].is_valid else none)
                out.append((i, len(data), removed, runs, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _frequent(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Anchors with more rows than a shard takes."""
    return scratch.staged(rows.groupBy("anchor").count().filter(F.col("count") > SHARD_CONTEXTS).select("anchor"), "frequent")


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left); a row for each row."""
    small_batches(spark)
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    texts = data.mapInArrow(_compressed, "doc_id long, packed binary")
    with Scratch(spark, "repeats") as scratch:
        rows = data.filter("doc_id is not null").mapInArrow(_anchor_rows, "anchor long, ctx long, doc_id long, at int, span short, copy boolean")
        dealt = F.when(F.col("copy"), F.xxhash64("doc_id", "at")).otherwise(F.col("anchor"))
        placed = rows.repartition(dealt).sortWithinPartitions("anchor", "ctx", "doc_id", "at")
        marks = scratch.staged(placed.mapInArrow(_marks, "anchor long, doc_id long, at int, span short, copy boolean"), "marks")
        several = marks.filter("not copy").drop("copy")
        frequent = _frequent(several, scratch)

        def contexts(places: DataFrame) -> DataFrame:
            """One document's places are bounded by its length."""
            of = places.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "at", "span")).alias("places"))
            return texts.join(of, "doc_id").select("doc_id", "packed", "places").mapInArrow(_contexts, CONTEXTS)

        if frequent.isEmpty():
            gathered, found = contexts(several), None
        else:
            gathered, found = contexts(several.join(frequent, "anchor", "left_anti")), None
            left = contexts(several.join(frequent, "anchor", "left_semi"))
            for step in (CORE_STEP, FINE_STEP):
                pieces = scratch.staged(left.mapInArrow(_pieces(step), CONTEXTS), "pieces")
                frequent = _frequent(pieces, scratch)
                gathered = gathered.unionByName(pieces.join(frequent, "anchor", "left_anti").select(pieces.columns))
                left = pieces.join(frequent, "anchor", "left_semi").select(pieces.columns)
                if frequent.isEmpty():
                    break
            else:
                found = _across(left, scratch)
        runs = gathered.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards, "doc_id long, s int, e int")
        found = runs if found is None else runs.unionByName(found)
        copies = marks.filter("copy").select("doc_id", F.col("at").alias("s"), (F.col("at") + F.shiftright("span", 7) + LENGTH - 1).cast("int").alias("e"))
        spans = staged(spark, copies.unionByName(found).groupBy("doc_id").agg(F.collect_list(F.shiftleft(F.col("s").cast("long"), 32) + F.col("e")).alias("spans")), "repeats-spans")
    whole = texts.filter("doc_id is not null").join(spans, "doc_id", "left").select("doc_id", "packed", "spans")
    unnamed = texts.filter("doc_id is null").select("doc_id", "packed", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return whole.unionByName(unnamed).mapInArrow(_cut_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
