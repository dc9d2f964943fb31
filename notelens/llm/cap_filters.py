"""Near copies among embeddings by spherical-cap filters: links, components and the vector that stays.

A filter is a direction; a vector takes every filter that it points to closely enough, and vectors that share one are
compared. Directions are the words of structured random product codes: the turned vector is cut into blocks, each block has
its own random words, and a direction joins one word of each. So millions of directions need no list of their own, and a
vector decodes to all that exceed the cap by extending prefixes while the best rest can still reach it. A vector in a thin
region of the code decodes with a wider cap, until ``least`` filters are found. With two codes a pair at a cosine of 0.93
shares none with a probability of some 1 in 10,000 (measured over random pairs), one at 0.98 less than 1 in 100,000; what
is found is verified, so no link is wrong.

Groups of near copies are not compared pair by pair. Equal vectors are one. Of vectors with the same best filter, those
within half the angle of the group's first one form a ball, whose members are all linked by the triangle inequality; balls
are candidates, and two of them link wholly, not at all, or, where the angles leave it open, member by member: first each
member against the other ball as a whole, then the members left open on both sides in blocks, as matrix products that
return counts. No pair of members ever becomes a row.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite components, and a vector whose label or id
is null, links with nothing: n_links 0, its own component, kept. Only vectors of one label and one length are compared.
Rows are vectors: repeated rows, of one id as well, link with each other; the component of a row without id is null. An empty table
gives an empty result. Other columns are not looked at. Components of any size are scaled before squaring.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.llm.components import connected_components
from notelens.llm.workers import built, small_batches
from notelens.sources.tables import Scratch, staged

CODES, BLOCKS, WORDS = 2, 4, 64
CAP, WIDER, LEAST = 4.64, 0.32, 16  # caps in standard deviations of a random product, 1 / sqrt(length)
BLOCK_ROWS = 512
EPS = 1e-6  # radians within which an angle decides nothing


class Code:
    """A random product code for vectors of one length: a rotation and the words of each block."""

    def __init__(self, length: int, number: int) -> None:
        rng = np.random.default_rng([length, number])
        blocks = min(BLOCKS, max(1, length // 4))
        self.turn = np.linalg.qr(rng.standard_normal((length, length)))[0]
        self.edges = np.linspace(0, length, blocks + 1).astype(int)
        words = [rng.standard_normal((WORDS, b - a)) for a, b in zip(self.edges, self.edges[1:], strict=False)]
        self.words = [w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(blocks) for w in words]
        self.size = WORDS**blocks

    def _above(self, products: list[np.ndarray], rest: list[np.ndarray], cap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, direction and product of each direction that reaches the cap."""
        row = np.arange(len(rest[0]))
        found, total = np.zeros(len(row), np.int64), np.zeros(len(row))
        for p, more in zip(products, rest, strict=True):
            i, j = np.nonzero(total[:, None] + p[row] + more[row][:, None] >= cap)
            total, found, row = total[i] + p[row[i], j], found[i] * WORDS + j, row[i]
        return row, found, total

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, direction and product for unit vectors; each row has LEAST directions at least, where the code has them."""
        turned = unit @ self.turn
        products = [turned[:, a:b] @ w.T for a, b, w in zip(self.edges, self.edges[1:], self.words, strict=False)]
        best = [p.max(axis=1) for p in products]
        rest = [np.sum(best[k + 1 :], axis=0) if k + 1 < len(best) else np.zeros(len(unit)) for k in range(len(best))]
        todo, cap, out = np.arange(len(unit)), CAP / math.sqrt(unit.shape[1]), []
        while len(todo):
            row, found, total = self._above([p[todo] for p in products], [r[todo] for r in rest], cap)
            enough = np.bincount(row, minlength=len(todo)) >= min(LEAST, self.size)
            take = enough[row]
            out.append((todo[row[take]], found[take], total[take]))
            todo, cap = todo[~enough], cap - WIDER / math.sqrt(unit.shape[1])
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors in double precision of the column, by length; nulls are left out."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    for length in np.unique(size[size > 0]):
        at = np.flatnonzero(size == length)
        x = values[start[at][:, None] + np.arange(length)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the filters of each x, and of each code the best one."""
    for batch in batches:
        filters, homes = [None] * len(batch), np.zeros((len(batch), CODES), np.int64)
        for at, unit in _units(batch.column("x")):
            rows, ids = [], []
            for k in range(CODES):
                row, found, total = _code(unit.shape[1], k).decode(unit)
                order = np.lexsort((found, -total, row))
                first = np.unique(row[order], return_index=True)[1]
                homes[at, k] = found[order][first]
                rows.append(row)
                ids.append(found * CODES + k)
            row, found = np.concatenate(rows), np.concatenate(ids)
            order = np.argsort(row, kind="stable")
            for place, part in zip(at, np.split(found[order], np.cumsum(np.bincount(row, minlength=len(at)))[:-1]), strict=True):
                filters[place] = part
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(filters, pa.list_(pa.int64())), *[pa.array(homes[:, k]) for k in range(CODES)]], [*batch.schema.names, "filters", *[f"home{k}" for k in range(CODES)]])


def _code(length: int, number: int) -> Code:
    return built(("cap codes", length), lambda: [Code(length, k) for k in range(CODES)])[number]


def _angles(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and angle of each pair of vectors of one length; the angle is exact for small ones too."""
    cos, angle = np.full(len(a), np.nan), np.full(len(a), np.nan)
    for (at, u), (_, v) in zip(_units(a), _units(b), strict=True):
        cos[at] = np.einsum("ij,ij->i", u, v)
        angle[at] = 2 * np.arctan2(np.linalg.norm(u - v, axis=1), np.linalg.norm(u + v, axis=1))
    return cos, angle


def _with_angle(df: DataFrame, keep: str) -> DataFrame:
    """The columns named in keep, with cos and angle of x and y in their place."""
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos, angle = _angles(batch.column("x"), batch.column("y"))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(cos), pa.array(angle)], [*names, "cos", "angle"])

    return df.mapInArrow(run, f"{keep}, cos double, angle double")


def _balls(scratch: Scratch, coded: DataFrame, floor: float) -> DataFrame:
    """The rows of coded with ball (the node of its first vector) and away (the angle to it)."""
    half = math.acos(floor) / 2 - EPS
    rest, joined = coded, []
    for k in range(CODES):
        key = ["label", "size", f"home{k}"]
        first = rest.groupBy(*key).agg(F.min("node").alias("ball"), F.count("*").alias("many")).filter("many > 1").drop("many")
        near = rest.select(*key, "node", "x").join(first, key).filter("node <> ball").select("node", "ball", "x")
        near = near.join(coded.select(F.col("node").alias("ball"), F.col("x").alias("y")), "ball")
        found = scratch.staged(_with_angle(near, "node bigint, ball bigint").filter(F.col("angle") <= half).select("node", "ball", F.col("angle").alias("away")), "joined")
        joined += [found, found.select(F.col("ball").alias("node"), "ball", F.lit(0.0).alias("away")).distinct()]
        if k + 1 < CODES:
            taken = found.select("node").union(found.select("ball")).distinct()
            rest = scratch.staged(rest.join(taken, "node", "left_anti"), "rest")
    members = joined[0]
    for more in joined[1:]:
        members = members.unionByName(more)
    placed = coded.join(members, "node", "left")
    return placed.select("node", "label", "size", "n", "first", "x", "filters", F.coalesce("ball", "node").alias("ball"), F.coalesce("away", F.lit(0.0)).alias("away"))


def _lean(cos: str, angle: str, radius: str, floor: float) -> str:
    """SQL: 2 if a vector at this angle of a center links with the whole ball, 0 if with none of it, 1 if that is open."""
    theta = math.acos(floor)
    return f"CASE WHEN {radius} = 0 THEN IF({cos} >= {floor}, 2, 0) WHEN {angle} + {radius} <= {theta - EPS} THEN 2 WHEN {angle} - {radius} > {theta + EPS} THEN 0 ELSE 1 END"


def _turned(df: DataFrame) -> DataFrame:
    return df.select(F.col("other").alias("ball"), F.col("ball").alias("other"), *[c for c in df.columns if c not in ("ball", "other")])


def _block_counts(floor: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ball, other, one, two in zip(*(batch.column(c) for c in ("ball", "other", "one", "two")), strict=True):
                node, n, unit = zip(*((s.values.field("node").to_numpy(), s.values.field("n").to_numpy(), next(_units(s.values.field("x")))[1]) for s in (one, two)), strict=True)
                hit = unit[0] @ unit[1].T >= floor
                if hit.any():
                    nodes, links = np.concatenate(node), np.concatenate([hit @ n[1], n[0] @ hit])
                    yield pa.RecordBatch.from_arrays([pa.array([ball.as_py()] * len(nodes)), pa.array([other.as_py()] * len(nodes)), pa.array(nodes), pa.array(links)], ["ball", "other", "node", "links"])

    return run


def _open_links(scratch: Scratch, unsure: DataFrame, floor: float) -> DataFrame:
    """ball, other, node, links: of members left open against each other's ball, those that do link; unsure has both
    directions. Members go in blocks of some BLOCK_ROWS, and every two blocks of a pair of balls meet in one product."""
    parts = unsure.groupBy("ball", "other").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    dealt = unsure.join(parts, ["ball", "other"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    blocks = scratch.staged(dealt.groupBy("ball", "other", "part").agg(F.collect_list(F.struct("node", "n", "x")).alias("rows")), "blocks")
    one = blocks.select("ball", "other", F.col("rows").alias("one")).filter("ball < other")
    two = _turned(blocks).select("ball", "other", F.col("rows").alias("two"))
    return scratch.staged(one.join(two, ["ball", "other"]).mapInArrow(_block_counts(floor), "ball bigint, other bigint, node bigint, links bigint"), "open")


def _classes(vectors: DataFrame) -> DataFrame:
    """One row for each different vector of a label that can link: x, label, size, first (its smallest id) and n."""
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & ~bad & F.exists("x", lambda e: e != 0)
    return vectors.filter(usable).groupBy("label", "x").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("size", F.size("x"))


def link_vectors(spark: SparkSession, table: DataFrame, floor: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of (vec_id, embedding, label), linked at a cosine of floor or more."""
    small_batches(spark)
    vectors = table.select("vec_id", "label", F.col("embedding").alias("x"))
    with Scratch(spark, "caps") as scratch:
        numbered = scratch.staged(_classes(vectors).withColumn("node", F.monotonically_increasing_id()), "classes")
        columns = ", ".join([*(f"{c} {kind}" for c, kind in numbered.dtypes), "filters array<bigint>", *(f"home{k} bigint" for k in range(CODES))])
        coded = scratch.staged(numbered.mapInArrow(_coded, columns), "coded")
        placed = scratch.staged(_balls(scratch, coded, floor), "placed")
        balls = placed.groupBy("ball").agg(F.max("away").alias("radius"), F.sum("n").alias("weight"), F.min("first").alias("first"))
        centers = placed.filter("node = ball").select("ball", "x").join(balls, "ball")
        centers = scratch.staged(centers, "centers")

        held = scratch.staged(placed.select("label", "size", "ball", F.explode("filters").alias("filter")).distinct(), "held")
        key = ["label", "size", "filter"]
        met = held.join(held.withColumnRenamed("ball", "other"), key).filter("ball < other").select("ball", "other").distinct()
        named = lambda v, r, x: centers.select(F.col("ball").alias(v), F.col("radius").alias(r), F.col("x").alias(x))
        met = met.join(named("ball", "radius", "x"), "ball").join(named("other", "other_radius", "y"), "other")
        whole = _lean("cos", "angle", "(radius + other_radius)", floor)
        pairs = scratch.staged(_with_angle(met, "ball bigint, other bigint, radius double, other_radius double").selectExpr("ball", "other", f"{whole} AS lean").filter("lean > 0"), "pairs")
        both_ways = lambda df: df.unionByName(_turned(df))

        sure = both_ways(pairs.filter("lean = 2").select("ball", "other"))
        of_ball = sure.join(balls.select(F.col("ball").alias("other"), "weight"), "other").groupBy("ball").agg(F.sum("weight").alias("links"))

        asked = both_ways(pairs.filter("lean = 1").select("ball", "other")).join(centers.select(F.col("ball").alias("other"), F.col("x").alias("y"), F.col("radius").alias("other_radius"), F.col("weight").alias("other_weight")), "other")
        asked = _with_angle(placed.select("ball", "node", "n", "x").join(asked, "ball"), "ball bigint, other bigint, node bigint, n bigint, other_radius double, other_weight bigint")
        leaning = scratch.staged(asked.selectExpr("ball", "other", "node", "n", "other_weight", f"{_lean('cos', 'angle', 'other_radius', floor)} AS lean").filter("lean > 0"), "leaning")
        wholly = leaning.filter("lean = 2").groupBy("ball", "other").agg(F.sum("n").alias("links"))
        unsure = leaning.filter("lean = 1")
        by_side = unsure.join(_turned(wholly), ["ball", "other"]).select("node", "links")
        opened = _open_links(scratch, unsure.join(placed.select("node", "x"), "node"), floor)
        of_node = leaning.filter("lean = 2").select("node", F.col("other_weight").alias("links")).unionByName(by_side).unionByName(opened.select("node", "links"))
        of_node = of_node.groupBy("node").agg(F.sum("links").alias("links"))

        links = pairs.filter("lean = 2").select("ball", "other").unionByName(wholly.select("ball", "other")).unionByName(opened.select("ball", "other")).distinct()
        comps = connected_components(spark, links.select(F.col("ball").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "ball")
        named_balls = scratch.staged(balls.join(comps, "ball", "left").withColumn("comp", F.coalesce("comp", "ball")), "named")
        least = named_balls.groupBy("comp").agg(F.min("first").alias("component_id"))
        by_ball = named_balls.join(least, "comp").join(of_ball, "ball", "left").select("ball", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("base"))
        solved = placed.select("label", "x", "node", "ball").join(by_ball, "ball").join(of_node, "node", "left")
        solved = solved.select("label", "x", "component_id", (F.col("base") + F.coalesce("links", F.lit(0))).alias("n_links"))
        found = vectors.join(solved, ["label", "x"], "left")
        n_links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links")
        component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id")
        return staged(spark, found.select("vec_id", n_links.cast("long").alias("n_links"), component, F.col("vec_id").eqNullSafe(component).alias("kept")), "caps")
