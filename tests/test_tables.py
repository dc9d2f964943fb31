"""The shared folder, and the driver entry without its optional part."""

from __future__ import annotations

import builtins
import os

import __spark_entry__ as entry
import pytest
from notelens.sources.tables import Scratch, remove, shared_dir, staged


def test_scratch_is_removed(spark):
    with Scratch(spark, "some") as scratch:
        kept = scratch.staged(spark.range(3).toDF("x"), "rows")
        assert kept.count() == 3
        folder = scratch.root.removeprefix("file://")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)
    remove(spark, scratch.root)
    assert staged(spark, spark.range(2), "rows").count() == 2


class Unset:
    """A session without the setting."""

    def __init__(self, spark, master):
        self.conf, self.sparkContext = self, self
        self.applicationId, self.master = spark.sparkContext.applicationId, master

    def get(self, key, default):
        return default


def test_a_cluster_needs_a_shared_folder(spark):
    one, two = (shared_dir(Unset(spark, "local[2]"), "x").removeprefix("file://").rsplit("/", 1)[0] for _ in range(2))
    assert one == two and os.path.isdir(one)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Unset(spark, "local-cluster[3,2,3000]"), "x")


def test_entry_without_an_importable_part(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    found = entry.queries()
    assert found and not any(n.startswith("op1_") or n == "pipeline" for n in found) and set(entry.oracle_sql()) <= set(found)
