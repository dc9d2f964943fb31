"""Exact n-gram Jaccard join with a token-group matrix.

Two documents link when 100 |A & B| >= 90 |A | B| for their sets of distinct word shingles. The result
gives each document its set size and the smallest id that links reach from it.

1. Each text becomes a sorted set of 64-bit shingle hashes. Documents with equal sets fold into the one
   with the smallest id; only these representatives go on.
2. Candidate cells. Sets a <= b that link differ in at most |a| / 9 shingles. Shingles are dealt to
   H + 1 parts by hash, H being the most that may differ, so linked sets agree wholly in one part. A
   signature is the hash of one part's content (with its size class); sets that share no signature
   cannot link. A part of some eight shingles says far more than one shingle, so a passage that many
   documents share does not make candidates of them.
3. Groups. The most central document of each signature is its hub. Each document is verified against
   the hub with which it shares most, which folds large groups of near copies into connected groups
   at a linear cost; a group larger than ``group_docs`` is stored in chunks.
4. Token-group matrix. Only documents whose signature also stands in another component are left. For
   these the union of shingles of each group is stored, and in coarse form the most shingles that any
   member has in each of 64 hash bins. For a query document and a group the overlap |q & union| bounds
   the similarity with every member, so only groups with
   100 |q & union| >= 90 (|q| + |smallest member| - |q & union|) are opened, and their members verified. The coarse
   form bounds the same overlap from above inside the join that finds the cells, so near copies that
   fall just short of the threshold leave it as a few rows and not as pairs.

All links between components are found this way; links inside a component change nothing. Nothing is
capped. Groups, signatures and links stay distributed; iterations write to the shared folder.

Defined cases: null, empty and blank texts have the empty set and link with nothing; with fewer words
than a shingle the whole sequence is the shingle; repeated rows fold like other copies; an empty
table gives an empty result; other columns are ignored. Ids are taken to tell documents apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.components import connected_components
from notelens.llm.workers import small_batches
from notelens.sources.tables import staged

U = np.uint64
NUM, DEN = 90, 100  # a link: DEN * shared >= NUM * union
_POWERS = np.zeros(0, U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(8, int(n - 1).bit_length())
        _POWERS = np.random.Generator(np.random.PCG64(20240101)).integers(1, 2**63, size, dtype=np.uint64) * U(2) + U(1)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_hashes(text: str) -> np.ndarray:
    """Hash of each word; words are runs without ASCII white space, A-Z count as a-z."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, U)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = ~blank
    starts = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return np.zeros(0, U)
    kept = np.flatnonzero(inside)
    offsets = np.searchsorted(kept, starts)
    lengths = np.diff(np.append(offsets, len(kept)))
    place = np.arange(len(kept)) - np.repeat(offsets, lengths)
    weights = _powers(int(lengths.max()) + 1)
    return mix(np.add.reduceat((raw[kept].astype(U) + U(1)) * weights[place], offsets) + lengths.astype(U))


def shingle_set(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    width = min(n, len(w))
    h = np.full(len(w) - width + 1, width, U)
    for i in range(width):
        h = mix(h * U(0x9E3779B97F4A7C15) + w[i : len(w) - width + 1 + i])
    return np.unique(h)


def _classes(limit: int = 1 << 33) -> np.ndarray:
    """Last size of each size class; sets that link are in one class or in neighbours."""
    ends, first = [], 1
    while first < limit:
        ends.append(first * DEN // NUM)
        first = ends[-1] + 1
    return np.array(ends, np.int64)


CLASS_ENDS = _classes()


def signatures(s: np.ndarray) -> np.ndarray:
    """Signatures of a set for its own size class and the one below."""
    own = int(np.searchsorted(CLASS_ENDS, len(s)))
    out = []
    mixed = mix(s + U(0x632BE59BD9B4E019))
    for k in (own, own - 1):
        differ = int(CLASS_ENDS[k]) * (DEN - NUM) // NUM if k >= 0 else 0
        if not differ:
            continue  # sets of such sizes link only if equal
        parts = differ + 1
        part = ((s >> U(13)) % U(parts)).astype(np.int64)
        half = ((s >> U(7)) & U(1)).astype(np.int64)
        order = np.argsort(2 * part + half, kind="stable")
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed[order])])
        ends = np.cumsum(np.bincount(2 * part + half, minlength=2 * parts))
        halves = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        size = np.bincount(part, minlength=parts)
        salt = mix(np.arange(parts).astype(U) * U(0x9E3779B97F4A7C15) + U(k))
        full = np.flatnonzero(size)
        out.append(mix(halves[2 * full] + halves[2 * full + 1] + salt[full]))
        # Where only an empty part agrees, each other part differs in one shingle, so in one half of the
        # next part there is none: the halves of the next part stand for an empty part.
        empty = np.flatnonzero(size == 0)
        after = (empty + 1) % parts
        for side in (0, 1):
            out.append(mix(halves[2 * after + side] + salt[empty] + U(0xA0761D6478BD642F + side)))
    return np.concatenate(out) if out else np.zeros(0, U)


def linked(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return DEN * shared >= NUM * (a + b - shared)


def _sets(data: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in data]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


@F.pandas_udf(T.LongType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_shared(x, y) for x, y in zip(_sets(a), _sets(b), strict=True)], dtype="int64")


BINS = 64


def bins(s: np.ndarray) -> list[int]:
    """How many shingles of a set fall in each bin; no two sets share more than the sum of their lesser counts."""
    return np.bincount((s >> U(40)).astype(np.int64) & (BINS - 1), minlength=BINS).tolist()


def _fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
                columns = [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([signatures(s).tobytes() for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "sigs"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, sigs binary")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            sigs = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            reps = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sigs])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sigs, np.zeros(0, np.int64)])), pa.array(reps)], ["sig", "rep"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature, those whose signature occurs again; holds one batch and one row."""
    sig, rep, open_run = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        s, r = np.concatenate([sig, batch.column(0).to_numpy()]), np.concatenate([rep, batch.column(1).to_numpy()])
        if not len(s):
            continue
        same = s[1:] == s[:-1]
        again = np.concatenate([[open_run], same]) | np.concatenate([same, [False]])
        out = again[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(s[:-1][out]), pa.array(r[:-1][out])], ["sig", "rep"])
        sig, rep, open_run = s[-1:], r[-1:], bool(same[-1]) if len(same) else open_run
    if len(sig) and open_run:
        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(rep)], ["sig", "rep"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b whose sets link."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").filter(f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)")
    return near.withColumn("shared", overlap("sa", "sb")).filter(f"{DEN} * shared >= {NUM} * (na + nb - shared)").select("a", "b")


def _hub_pairs(multi: DataFrame) -> DataFrame:
    """For each document the hub with which it shares most signatures; hubs are the most central documents."""
    degree = multi.join(multi.groupBy("sig").count(), "sig").groupBy("rep").agg(F.sum("count").alias("degree"))
    central = multi.join(degree, "rep").groupBy("sig").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"))).alias("h"))
    pairs = multi.join(central.select("sig", (-F.col("h.minus")).alias("hub")), "sig").filter("rep <> hub")
    return pairs.groupBy("rep", "hub").count().groupBy("rep").agg(F.max(F.struct("count", (-F.col("hub")).alias("minus"))).alias("m")).select(F.col("rep").alias("a"), (-F.col("m.minus")).alias("b"))


def _union(data: pd.DataFrame) -> pd.DataFrame:
    sets = _sets(data["set"])
    peaks = np.max(np.stack(data["bins"]), 0).tolist()
    return pd.DataFrame({"comp": data["comp"].iloc[:1], "chunk": data["chunk"].iloc[:1], "least": [data["n"].min()], "tokens": [np.unique(np.concatenate(sets)).tobytes()], "peaks": [peaks]})


def _matrix_links(spark: SparkSession, rest: DataFrame, sets: DataFrame, group_docs: int) -> DataFrame:
    """Links between components among rows (sig, rep, comp), through the token-group matrix."""
    docs = rest.select("rep", "comp").distinct()
    sizes = docs.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    members = staged(spark, docs.join(sizes, "comp").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / group_docs).cast("long"))), "jaccard-members")
    matrix = staged(spark, members.join(sets, "rep").groupBy("comp", "chunk").applyInPandas(_union, "comp long, chunk long, least long, tokens binary, peaks array<int>").withColumnsRenamed({"comp": "gcomp", "chunk": "gchunk"}), "jaccard-matrix")
    placed = rest.select("sig", "rep").join(members, "rep")
    groups = placed.select("sig", F.col("comp").alias("gcomp"), F.col("chunk").alias("gchunk"), F.col("size").alias("gsize")).distinct().join(matrix.drop("tokens"), ["gcomp", "gchunk"])
    asked = placed.join(sets.select("rep", "n", "bins"), "rep")
    coarse = F.aggregate(F.zip_with("bins", "peaks", lambda a, b: F.least(a, b)), F.lit(0), lambda total, x: total + x)
    likely = (F.col("size") < F.col("gsize")) | ((F.col("size") == F.col("gsize")) & (F.col("comp") < F.col("gcomp")))
    cells = asked.join(groups, "sig").filter(likely & (DEN * coarse >= NUM * (F.col("n") + F.col("least") - coarse))).select("rep", "gcomp", "gchunk").distinct()
    queries = sets.select("rep", "n", F.col("set").alias("tokens_q"))
    bound = cells.join(queries, "rep").join(matrix.drop("peaks"), ["gcomp", "gchunk"])
    opened = bound.withColumn("most", overlap("tokens_q", "tokens")).filter(f"{DEN} * most >= {NUM} * (n + least - most)").select("rep", "gcomp", "gchunk")
    inside = members.join(sets.select("rep", F.col("n").alias("nb"), F.col("bins").alias("peaks")), "rep").select(F.col("rep").alias("b"), F.col("comp").alias("gcomp"), F.col("chunk").alias("gchunk"), "nb", "peaks")
    asking = opened.join(sets.select("rep", "n", "bins"), "rep")
    pairs = asking.join(inside, ["gcomp", "gchunk"]).filter(DEN * coarse >= NUM * (F.col("n") + F.col("nb") - coarse))
    return _verified(pairs.select(F.col("rep").alias("a"), "b"), sets)


def jaccard_components(spark: SparkSession, docs: DataFrame, shingle: int = 3, group_docs: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id; one row for each row of docs."""
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = staged(spark, _fingerprints(texts, shingle), "jaccard-prints")
    reps = prints.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("sigs").alias("sigs"))
    rows = reps.select("rep", "sigs").mapInArrow(_explode, "sig long, rep long")
    multi = staged(spark, rows.repartition("sig").sortWithinPartitions("sig").mapInArrow(_repeated, "sig long, rep long"), "jaccard-signatures")

    wanted = multi.select(F.col("rep").alias("doc_id")).distinct()

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([bins(s) for s in found], pa.list_(pa.int32()))], ["rep", "n", "set", "bins"])

    sets = staged(spark, texts.join(wanted, "doc_id", "left_semi").mapInArrow(as_sets, "rep long, n long, set binary, bins array<int>"), "jaccard-sets")
    links = staged(spark, _verified(_hub_pairs(multi), sets), "jaccard-links")
    comps = connected_components(spark, links)
    placed = multi.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", F.coalesce("comp", "rep").alias("comp"))
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("sig")
    rest = staged(spark, placed.join(mixed, "sig"), "jaccard-rest")
    if not rest.isEmpty():
        more = staged(spark, _matrix_links(spark, rest, sets, group_docs), "jaccard-links")
        if not more.isEmpty():
            comps = connected_components(spark, links.unionByName(more))
    owner = reps.select("digest", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    whole = prints.select("doc_id", "n", "digest").join(owner, "digest", "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
