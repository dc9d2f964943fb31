"""What Python workers hold: batches of a bounded size, and one built object at a time."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import TypeVar

from pyspark.sql import SparkSession

Built = TypeVar("Built")
BATCH_BYTES = 16 << 20
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_BUILT: dict = {}


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes that go to a worker at once for this session, where its setting allows more: rows of very long
    texts would fill its memory."""
    allowed = spark.conf.get(LIMIT).lower().removesuffix("b")
    if not allowed.isdigit() or not 0 < int(allowed) <= BATCH_BYTES:
        spark.conf.set(LIMIT, str(BATCH_BYTES))


def built(key: Hashable, build: Callable[[], Built]) -> Built:
    """The worker's object of this key. Workers serve many stages; what another one has built goes first."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build()
    return _BUILT[key]
