"""Quality classifier: gated attention over the passages of a document.

Each document is a bag of passages (blocks of its UTF-8 bytes). A passage is encoded from the shares of
byte classes and of hashed pairs of classes in it, through one learned layer. Gated attention
(softmax of w . (tanh(V h) * sigmoid(U h))) weighs the passages, and a logistic layer scores the
weighted sum. All weights are learned together, from labels of whole documents only.

Training takes a bounded sample of labelled rows, bounded in rows and in bytes of text; a sampled row is
learned from with all its passages. Everything else reads whole texts of all rows.

Defined cases: null and empty texts are one passage of zeros and get a score; rows without label are
not learned from; a label table without usable rows gives the constant score 0.5; a document labelled
more than once counts once for each label row, and repeated rows of it count each; rows are scored
one by one, so repeated rows get equal scores; a very long text is scored whole, but learned from only
if the sample has room for all of it; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.workers import small_batches

PASSAGE = 512
PIECE = 2048 * PASSAGE
CLASSES, PAIRS = 48, 128
WIDTH = CLASSES + PAIRS + 5
POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
HIDDEN, GATE = 24, 12
SLICE_BYTES = 4_000_000


def _classes() -> np.ndarray:
    """A class for each byte: letters without case, upper case apart, digits, common signs, UTF-8 bytes."""
    of = np.full(256, 47, np.uint8)
    of[ord("a") : ord("z") + 1] = np.arange(26)
    of[ord("A") : ord("Z") + 1] = 26
    of[ord("0") : ord("9") + 1] = 27
    for i, c in enumerate(" \n\t.,;:!?'\"-|#$%&*/"):
        of[ord(c)] = 28 + min(i, 17)
    of[128:192] = 46
    of[192:256] = 46
    return of


CLASS = _classes()
PAIR = ((np.arange(CLASSES * CLASSES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.int64)


def encode(data: bytes) -> np.ndarray:
    """One row of features for each passage. Pairs and words end at every ``PIECE`` bytes, which bounds the memory."""
    n = len(data)
    if n > PIECE:
        return np.concatenate([encode(data[at : at + PIECE]) for at in range(0, n, PIECE)])
    m = max(1, -(-n // PASSAGE))
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    raw = np.frombuffer(data, np.uint8)
    c = CLASS[raw].astype(np.int64)
    passage = np.arange(n) // PASSAGE
    size = np.minimum(PASSAGE, n - PASSAGE * np.arange(m)).astype(np.float32)
    single = np.bincount(passage * CLASSES + c, minlength=m * CLASSES).reshape(m, CLASSES)
    pairs = np.bincount(passage[1:] * PAIRS + PAIR[c[:-1] * CLASSES + c[1:]], minlength=m * PAIRS).reshape(m, PAIRS)
    same = np.bincount(passage[1:], weights=raw[1:] == raw[:-1], minlength=m)
    signs = single[:, 30:46].sum(1)
    starts = np.flatnonzero((raw > 32) & (np.concatenate([[32], raw[:-1]]) <= 32))
    again = words = np.zeros(m)
    if len(starts):
        lengths = np.diff(np.append(starts, n))
        hashed = np.add.reduceat(np.where(raw > 32, raw, 0)[starts[0] :] * POWERS[(np.arange(starts[0], n) - np.repeat(starts, lengths)) & 63], starts - starts[0])
        words = np.bincount(passage[starts], minlength=m)
        again = np.bincount(passage[starts[1:]], weights=hashed[1:] == hashed[:-1], minlength=m)
    rest = np.stack([same / size, signs / size, single[:, 26] / size, np.log1p(size) / 6.5, again / np.maximum(words, 1)], 1)
    return np.concatenate([single / size[:, None], pairs / size[:, None], rest], 1).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        a = (v * u) @ w["w"]
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "p": p}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return self.forward((np.concatenate(bags) - self.mean) / self.scale, starts, bag)["p"]


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> Model | None:
    """Adam on the whole sample; None if there is nothing to tell apart."""
    if len(bags) == 0:
        return None
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags).astype(np.float32)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    y = labels.astype(np.float32)
    shapes = {"E": (WIDTH, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}
    weights = {k: (rng.normal(0, s[0] ** -0.5, s) if len(s) > 1 or k in "wc" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    model = Model(mean, scale, weights)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for t in range(1, epochs + 1):
        s = model.forward(x, starts, bag)
        d = ((s["p"] - y) / len(y))[:, None]
        g = {"c": (s["z"] * d).sum(0), "b": d.sum(0)}
        dz = (d * weights["c"])[bag]
        da = (dz * s["h"]).sum(1)
        da = s["a"] * (da - np.add.reduceat(s["a"] * da, starts)[bag])
        g["w"] = (s["v"] * s["u"] * da[:, None]).sum(0)
        dv = da[:, None] * weights["w"] * s["u"] * (1 - s["v"] ** 2)
        du = da[:, None] * weights["w"] * s["v"] * s["u"] * (1 - s["u"])
        g["V"], g["U"] = s["h"].T @ dv, s["h"].T @ du
        dh = (s["a"][:, None] * dz + dv @ weights["V"].T + du @ weights["U"].T) * (1 - s["h"] ** 2)
        g["E"], g["e"] = x.T @ dh, dh.sum(0)
        for k, v in weights.items():
            step = g[k] + decay * v
            first[k] = 0.9 * first[k] + 0.1 * step
            second[k] = 0.999 * second[k] + 0.001 * step**2
            v -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_bytes: int = 32_000_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits on a bounded sample of labelled rows that are not held out: the first ``max_docs`` in the order of a hash of
    their ids, without those for which ``max_bytes`` of text leave no room. Every passage of a sampled row is encoded."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_docs)
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_data"))
    rows = chosen.collect()  # max_docs rows of id and label
    listed = lambda found: F.broadcast(docs.sparkSession.createDataFrame(found, chosen.schema))
    sizes = text.join(listed(rows).select("_id").distinct(), "_id").groupBy("_id").agg(F.sum(F.octet_length("_data")).alias("n"))
    size_of, room, held = dict(map(tuple, sizes.collect())), max_bytes, []
    for row in rows:
        n = size_of.get(row["_id"]) or 0
        if n <= room:
            held.append(row)
            room -= n
    sample = text.join(listed(held), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [encode(data or b"").astype(np.float16).tobytes() for data in batch.column("_data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), pa.array(bags, pa.binary())], ["id", "label", "bag"])

    schema = T.StructType([T.StructField("id", sample.schema["_id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("bag", T.BinaryType())])
    rows = sorted(sample.mapInArrow(run, schema).collect())
    return fit([np.frombuffer(r["bag"], np.float16).astype(np.float32).reshape(-1, WIDTH) for r in rows], np.array([r["label"] for r in rows]))


def with_score(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds the score of each row's whole text."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != name]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scored(batches, model, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(scores)], [*names, name])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def _scored(batches: Iterator[pa.RecordBatch], model: Model | None, text_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows with their scores; a slice ends after 200 rows or where its texts reach a bound."""
    for whole in batches:
        column, at = whole.column(whole.schema.get_field_index(text_col)), 0
        while at < whole.num_rows:
            bags, size = [], 0
            while at + len(bags) < whole.num_rows and len(bags) < 200 and size < SLICE_BYTES:
                data = (column[at + len(bags)].as_py() or "").encode("utf-8", "surrogatepass")
                bags.append(encode(data))
                size += len(data)
            scores = model.score(bags) if model else np.full(len(bags), 0.5)
            yield whole.slice(at, len(bags)), scores.astype(np.float64)
            at += len(bags)


def drop_below(docs: DataFrame, model: Model | None, floor: float, text_col: str = "text") -> DataFrame:
    """Rows of docs, with all their columns and no other, whose score is not below the floor."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scored(batches, model, text_col):
            yield batch.filter(pa.array(scores >= floor))

    return docs.mapInArrow(run, docs.schema)
