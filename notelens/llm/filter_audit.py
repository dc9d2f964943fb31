"""What a chain of document filters removes in every order of its filters.

The orders form a trie. It is walked depth first; the state after a prefix is the DataFrame of what that prefix leaves,
persisted, and since it depends on the set of filters alone, prefixes of the same set share one state. Every edge of the
trie counts, over the survivors of its state, what its filter takes from them.

A verdict on a document never changes on the way, so survivors hold one row for each part and set of verdicts with the
number of its documents: the texts are read once, and a part that holds most documents takes no more rows than others.

Defined cases: a null or empty text has no words, so it fails A and no other filter of its own; null parts are the part '';
a row without id has no label, is never a copy and makes no other row one; rows of equal text and equal id are not copies
of each other; of several labels of one document a 1 counts; an empty table has no parts, so no rows. Other columns of
the documents, whatever their names, are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelens.sources.tables import Scratch, staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, r"[#$%&*|]"


def _own_verdicts(text: Column) -> dict[str, Column]:
    """The filters that look at one text: too few words, too many repeated words, too many capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * capitals > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def document_verdicts(scratch: Scratch, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (whether a document fails the filter), good and toxic, for each document.

    E, a copy of a text with a smaller id, needs all documents: of each text the smallest id is found with a partial
    aggregate, and the ids that are first of their text are joined back by id and digest, which no group of copies makes hot.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[v.alias(k) for k, v in _own_verdicts(text).items()])
    own = scratch.staged(own, "own")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return own.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").select("part", "A", "B", "C", "D", copy.alias("E"), flag("good"), flag("toxic"))


def _walk(state: frozenset, survivors: DataFrame, filters: str, seen: dict[frozenset, DataFrame], visit: Callable) -> None:
    """Depth first over the states below this one that have a filter left; one that another prefix has reached is not
    entered again. A state read more than once, by its count and by those below it, is persisted."""
    rest = [name for name in filters if name not in state]
    seen[state] = survivors.persist() if len(rest) > 1 else survivors
    visit(state, seen[state])
    for name in rest if len(rest) > 1 else []:
        if state | {name} not in seen:
            _walk(state | {name}, seen[state].filter(f"NOT {name}"), filters, seen, visit)


def _edges(survivors: DataFrame, state: frozenset, filters: str) -> DataFrame:
    """part, state, filter and what the filter removes from the survivors of the state, for each filter not yet applied."""
    counts = [f"struct('{f}' AS filter, sum(n) AS before, sum(if({f}, n, 0)) AS removed, sum(if({f} AND good, n, 0)) AS good_lost, sum(if({f} AND toxic, n, 0)) AS toxic_lost)" for f in filters if f not in state]
    return survivors.groupBy("part").agg(F.expr(f"array({', '.join(counts)}) AS edge")).selectExpr("part", f"'{''.join(sorted(state))}' AS state", "inline(edge)")


def _union(frames: list[DataFrame]) -> DataFrame:
    """Halves first: each union analyses all below it anew."""
    half = len(frames) // 2
    return _union(frames[:half]).unionByName(_union(frames[half:])) if half else frames[0]


def _orders(spark: SparkSession, filters: str) -> DataFrame:
    """filter_order, step, state and filter: n! orders of n steps."""
    rows = [("".join(o), k + 1, "".join(sorted(o[:k])), o[k]) for o in itertools.permutations(filters) for k in range(len(o))]
    return spark.createDataFrame(rows, "filter_order string, step int, state string, filter string")


def interactions(spark: SparkSession, verdicts: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and the counts of that step, for each part, order and step; verdicts as of document_verdicts.

    kept, removed, redundant (fails the filter, gone before), unique_fails (fails this filter alone), good_lost, toxic_lost
    and shapley (removed by the filter, over all orders).
    """
    n = len(filters)
    with Scratch(spark, "interactions") as scratch:
        profile = scratch.staged(verdicts.groupBy("part", *filters, "good", "toxic").agg(F.count("*").alias("n")), "profile")
        seen: dict[frozenset, DataFrame] = {}
        counted: list[DataFrame] = []
        _walk(frozenset(), profile, filters, seen, lambda state, left: counted.append(_edges(left, state, filters)))
        edges = scratch.staged(_union(counted), "edges")
        for left in seen.values():
            left.unpersist()

        states = {f: ["".join(s) for k in range(n) for s in itertools.combinations(sorted(set(filters) - {f}), k)] for f in filters}
        alone = {f: " AND ".join(x if x == f else f"NOT {x}" for x in filters) for f in filters}
        whole = [f"struct('{f}' AS filter, array({', '.join(map(repr, states[f]))}) AS states, sum(if({f}, n, 0)) AS fails, sum(if({alone[f]}, n, 0)) AS unique_fails)" for f in filters]
        every = profile.groupBy("part").agg(F.expr(f"array({', '.join(whole)}) AS f")).selectExpr("part", "inline(f)").selectExpr("part", "filter", "fails", "unique_fails", "explode(states) AS state")

        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)  # noqa: E731  a state that leaves nothing of a part has no edges for it
        full = every.join(edges, ["part", "state", "filter"], "left").select("part", "state", "filter", "fails", "unique_fails", *map(zero, ("before", "removed", "good_lost", "toxic_lost")))
        ways = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.length("state") + 1)
        full = full.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "filter")))
        steps = full.join(F.broadcast(_orders(spark, filters)), ["state", "filter"])
        return staged(spark, steps.select("part", "filter_order", "step", (F.col("before") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"), "interactions")


def audit_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of filters A to E on documents, by source."""
    with Scratch(spark, "verdicts") as scratch:
        return interactions(spark, document_verdicts(scratch, docs, labels))
