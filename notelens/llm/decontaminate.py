"""Benchmark decontamination with the q-gram lemma.

An item of m characters and a region of a document within k edits share at least m - q + 1 - k q
character q-grams, and these lie on at most k + 1 neighbouring diagonals. So for each document the
shared q-grams are counted in bands of 2 (k + 1) diagonals, each overlapping half of the next; bands
with enough of them are kept, and a banded alignment of the item with the region decides.

Texts are compared with A-Z in lower case and each white-space character as a space; positions are
code points of the text as given. The budget of an item is ``rate`` of its length, or less where a
short item would need a bound of no q-gram; items shorter than q must occur exactly.

The benchmark is a stated query set: it is taken in blocks of bounded text, each broadcast while it is
held against all rows of the documents, and released before the next.

Memory is bounded whatever the texts repeat: long texts are read in overlapping windows, and where the
shared q-grams of a window and the items make more than ``PAIRS`` pairs, items are taken in groups, and
an item that alone makes more marks its places band by band in a table of some ten bytes for each
character of the window. Overlapping bands of one item are aligned as one wider band. Nothing is left out.

Defined cases: null and empty texts match nothing, empty items match nothing; repeated items or rows
each get their own rows; of several places of an item the one of fewest edits counts, then the earliest
start, then the earliest end; null ids are kept as null; texts of any length are read whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.llm.places import with_place
from notelens.llm.workers import built, small_batches
from notelens.sources.tables import shared_dir

Q, RATE, BLOCK_CHARS = 8, 0.10, 2_000_000
PAIRS, WINDOW = 1_000_000, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BITS = 22
LOWER = np.arange(129, dtype=np.uint32)
LOWER[65:91] += 32
LOWER[9:14] = 32


def codes(text: str) -> np.ndarray:
    """Code points, with A-Z in lower case and white space as spaces."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, LOWER[np.minimum(c, 128)], c)


FOUND = "doc_id long, item_id long, start int, end int, edits int"


def locate(part: np.ndarray, whole: np.ndarray) -> int:
    """First place of part in whole, or -1."""
    a, b, at = part.tobytes(), whole.tobytes(), -1
    while (at := b.find(a, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for s in range(q):
        h *= BASE
        h += c[s : s + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


class Index:
    """The q-grams of one block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> None:
        self.q, self.ids = q, [i for i, _ in items]
        self.codes = [codes(t) for _, t in items]
        m = np.array([len(c) for c in self.codes], np.int64)
        self.k = np.maximum(0, np.minimum((m * rate).astype(np.int64), (m - q) // q))
        self.need = m - q + 1 - self.k * q
        self.short = [i for i in range(len(items)) if 0 < m[i] < q]
        grams = [gram_hashes(c, q) for c in self.codes]
        every = np.concatenate([*grams, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.gram_of = np.repeat(np.arange(len(self.grams)), self.count)
        self.by_owner = np.argsort(self.owner, kind="stable")
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.grams >> np.uint64(64 - BITS)] = True
        whole = self.need[m >= q]
        self.least = int(whole.min()) if len(whole) else 0
        self.span = int((m + self.k).max()) if len(m) else 0

    def regions(self, text_codes: np.ndarray) -> np.ndarray:
        """Rows (item, lowest diagonal) of the bands that hold enough shared q-grams."""
        h = gram_hashes(text_codes, self.q)
        none = np.zeros((0, 2), np.int64)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - BITS)])
        if len(at) < self.least or not len(self.grams):
            return none
        found = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[found] == h[at]
        at, found = at[same], found[same]
        if len(at) < self.least:
            return none
        # hits that have fewer than the least need of any item within the span of the longest are out
        near = np.searchsorted(at, at + self.span) - np.searchsorted(at, at - self.span)
        at, found = at[near >= self.least], found[near >= self.least]
        if not len(at):
            return none
        count = self.count[found]
        if count.sum() > PAIRS:
            return self._by_items(at, found)
        post = _ranges(self.first[found], count)
        return self._bands(self.owner[post], np.repeat(at, count), self.place[post])

    def _bands(self, item: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bands with enough of the shared q-grams, given as item, position in the text and place in the item."""
        width = self.k[item] + 1
        band = np.floor_divide(at - place, width)
        lowest = int(band.min()) - 1
        key = np.concatenate([band, band - 1]) - lowest
        size = int(key.max()) + 1
        key = np.concatenate([item, item]) * size + key
        # a place of an item counts once in a band, however often its q-gram stands there
        key, shared = np.unique(np.unique(key * self.span + np.concatenate([place, place])) // self.span, return_counts=True)
        owner = key // size
        kept = shared >= self.need[owner]
        owner = owner[kept]
        return np.stack([owner, (key[kept] % size + lowest) * (self.k[owner] + 1)], 1)

    def _by_items(self, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The same for more pairs than are made at once: items in groups, and heavy items each alone."""
        order = np.argsort(found, kind="stable")
        at = at[order]
        times = np.bincount(found, minlength=len(self.grams))
        begin = np.cumsum(times) - times
        post = self.by_owner[times[self.gram_of[self.by_owner]] > 0]
        weight = times[self.gram_of[post]]
        load = np.bincount(self.owner[post], weights=weight).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], self.owner[post][1:] != self.owner[post][:-1]]))
        out, group, pairs = [np.zeros((0, 2), np.int64)], [], 0

        def done() -> None:
            if group:
                some = np.concatenate(group)
                n = times[self.gram_of[some]]
                out.append(self._bands(np.repeat(self.owner[some], n), at[_ranges(begin[self.gram_of[some]], n)], np.repeat(self.place[some], n)))

        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(post)], strict=True):
            n = int(load[self.owner[post[a]]])
            if n > PAIRS:
                out.append(self._of_one(post[a:b], at, times, begin))
                continue
            if pairs + n > PAIRS:
                done()
                group, pairs = [], 0
            group.append(post[a:b])
            pairs += n
        done()
        return np.concatenate(out)

    def _of_one(self, post: np.ndarray, at: np.ndarray, times: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Bands of one item, from a table of bands and places that its pairs mark in parts of bounded size."""
        i = int(self.owner[post[0]])
        width, places = int(self.k[i]) + 1, len(self.codes[i]) - self.q + 1
        base = -(-places // width) + 1  # row of the band of diagonal 0
        seen = np.zeros((base + int(at.max()) // width + 1, places), bool)
        for p in post.tolist():
            first, n, place = int(begin[self.gram_of[p]]), int(times[self.gram_of[p]]), int(self.place[p])
            band = np.floor_divide(at[first : first + n] - place, width) + base
            seen[band, place] = True
            seen[band - 1, place] = True
        kept = np.flatnonzero(seen.sum(1) >= self.need[i])
        return np.stack([np.full(len(kept), i), (kept - base) * width], 1)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(position of the item in the block, start, end, edits), one for each item that occurs: its first
        place of fewest edits."""
        whole = codes(text)
        best: dict[int, tuple[int, int, int]] = {}
        overlap = 2 * self.span + 8  # an occurrence with room for its band lies in one window
        for at in range(0, max(1, len(whole) - overlap), WINDOW):
            c = whole[at : at + WINDOW + overlap]
            for i, low, high in self._runs(self.regions(c)):
                if i in best and not best[i][0]:
                    continue  # runs of an item come in order, so there is no earlier place
                got = self._verified(i, low, high, c)
                got = got and (got[0], got[1] + at, got[2] + at)
                if got and (i not in best or got < best[i]):
                    best[i] = got
        for i in self.short:
            if (at := locate(self.codes[i], whole)) >= 0:
                best[i] = (0, at, at + len(self.codes[i]))
        return [(i, start, end, edits) for i, (edits, start, end) in sorted(best.items())]

    def _runs(self, regions: np.ndarray) -> list[tuple[int, int, int]]:
        """Overlapping bands of one item as one: (item, lowest diagonal, end of the highest)."""
        if not len(regions):
            return []
        regions = regions[np.lexsort((regions[:, 1], regions[:, 0]))]
        item, low = regions[:, 0], regions[:, 1]
        high = low + 2 * (self.k[item] + 1)
        first = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (low[1:] > high[:-1])]))
        last = np.append(first[1:], len(item)) - 1
        return list(zip(item[first].tolist(), low[first].tolist(), high[last].tolist(), strict=True))

    def _verified(self, i: int, low: int, high: int, c: np.ndarray) -> tuple[int, int, int] | None:
        """(edits, start, end) of an item on these diagonals, if it occurs there."""
        item, k = self.codes[i], int(self.k[i])
        low, width = low - k, high - low + 2 * k  # occurrences begin in a band and stray k diagonals at most
        lo, hi = max(0, low), min(len(c), low + width + len(item))
        exact = locate(item, c[lo:hi])
        return (0, lo + exact, lo + exact + len(item)) if exact >= 0 else align(item, c, k, low, width)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each range, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def align(item: np.ndarray, text: np.ndarray, k: int, low: int = 0, width: int | None = None) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of a text nearest to an item, if within k edits, over ``width`` diagonals from
    ``low`` on: fewest edits, then earliest start, then earliest end. Row after row of the item, each cell stands for a
    diagonal, the text position less the place in the item, and holds edits and start in one number, so that the least
    number is the best of both."""
    n, m = len(text), len(item)
    width = n + m + 1 if width is None else width
    steps, edit = np.arange(width), width + 1
    far = (m + n + 1) * edit
    padded = np.concatenate([np.full(max(0, -low), 0xFFFFFFFF, np.uint32), text[max(0, low) :], np.full(max(0, low + width + m - n), 0xFFFFFFFF, np.uint32)])
    best = np.where((steps + low >= 0) & (steps + low <= n), steps, far)
    for i, c in enumerate(item.tolist(), 1):
        across = best + (padded[i - 1 : i - 1 + width] != c) * edit
        down = np.append(best[1:] + edit, far)  # a place of the item is left out
        inside = (steps + low + i >= 0) & (steps + low + i <= n)
        new = np.where(inside, np.minimum(across, down), far)
        # a run of insertions: new[j] = min over l <= j of new[l] + j - l edits
        best = np.where(inside, np.minimum.accumulate(new - steps * edit) + steps * edit, far)
        if best.min() // edit > k:
            return None
    end = int(np.argmin(best))
    edits, start = divmod(int(best[end]), edit)
    return (edits, start + low, end + low + m) if edits <= k else None


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most block_chars characters (one item more at most)."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if row["t"]:
            block.append((row["i"], row["t"]))
            size += len(row["t"])
            if size >= block_chars:
                yield block
                block, size = [], 0
    if block:
        yield block


def _indexed(broadcast, token: str, q: int, rate: float) -> Index:
    return built(("index", token, q, rate), lambda: Index(broadcast.value, q, rate))


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, start, end, edits: a row for each document and item that occurs in it."""
    small_batches(spark)
    pruned = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def against(block: list[tuple[int, str]]) -> DataFrame:
        sent, token = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _indexed(sent, token, q, rate)
            for batch in batches:
                rows = [(d, index.ids[i], s, e, edits) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for i, s, e, edits in index.matches(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64() if j < 2 else pa.int32()) for j in range(5)], ["doc_id", "item_id", "start", "end", "edits"])

        return pruned.mapInArrow(run, FOUND)

    return _block_by_block(spark, blocks(benchmark, item_col, "text", block_chars), against, FOUND)


def _block_by_block(spark: SparkSession, found: Iterator[list[tuple[int, str]]], against: Callable[[list[tuple[int, str]]], DataFrame], schema: str) -> DataFrame:
    """The rows of all blocks. One block is a plain plan; of several each is written before the next is read, so
    neither the plan nor what is broadcast grows with their number."""
    first, second = next(found, None), next(found, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return against(first)
    path = shared_dir(spark, "blocks")
    for block in itertools.chain((first, second), found):
        against(block).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Rows of docs in which no item occurs, with all their columns. One block of items filters rows where they lie;
    with more the rows found are left out by their places."""
    small_batches(spark)
    found = blocks(benchmark, item_col, "text", block_chars)
    first, second = next(found, None), next(found, None)
    if first is None:
        return docs
    holds = lambda block: _holds(spark.sparkContext.broadcast(block), uuid.uuid4().hex, q, rate)
    if second is None:
        return docs.filter(~holds(first)(F.col(text_col)))
    placed = with_place(spark, docs)
    text = F.col("whole").getField(text_col)
    gone = _block_by_block(spark, itertools.chain((first, second), found), lambda block: placed.filter(holds(block)(text)).select("place"), "place struct<file string, row bigint>")
    return placed.join(gone.distinct(), "place", "left_anti").select("whole.*")


def _holds(sent, token: str, q: int, rate: float):
    @F.pandas_udf("boolean")
    def holds(text: pd.Series) -> pd.Series:
        index = _indexed(sent, token, q, rate)
        return text.map(lambda t: bool(t and index.matches(t)))

    return holds
