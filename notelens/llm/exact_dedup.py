"""Exact deduplication with streaming keyed state.

A stream of fingerprints feeds a keyed aggregation whose state lives in RocksDB on the executors'
disks and never expires (no watermark). For each digest the state holds the largest stable
identifier, a content locator (file and row number, which find the text again) and the number of rows.
Rows that hit a digest which another row holds are fetched by their locators and compared byte by byte
with the row that stays; should two different texts ever share a digest, they are told apart by the
text itself.

With a ``state_root`` the state outlives the call. New texts are then also kept below that folder, as
the files of ``docs`` may go, and a row whose identifier and digest are held already is no new row, so
a repeated or resumed call counts nothing twice.

Defined cases: a null text counts as the empty text; a null id sorts below every other id; rows with
the same id and text all count in group_size when they come in one call, and share keep_id and kept;
texts of any length are digested and compared whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.llm.places import with_place
from notelens.sources.tables import Scratch, exists, staged

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores would each set disk space aside
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # only the stores of running tasks are in memory
}


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def fingerprints(placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, digest (32 bytes), n_bytes and place of each row of ``with_place``."""
    text = F.coalesce(F.col("whole").getField(text_col), F.lit(""))
    return placed.select(
        F.col("whole").getField(id_col).cast("long").alias("doc_id"), text.alias("text"), _digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), "place",
    )


def keyed_state(spark: SparkSession, stream: DataFrame, root: str) -> DataFrame:
    """Runs the stateful query over a stream of fingerprints to its present end.

    The checkpoint below ``root`` keeps the state: a later call with the same root and the same
    stream takes in only what is new. Returns digest, keep_id, locator, n_bytes, group_size.
    """
    grouped = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "place", "n_bytes")).alias("keeper"))
    updates = f"{root}/updates"
    spark.createDataFrame([], grouped.schema).write.mode("overwrite").parquet(f"{updates}/batch=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={batch_id}")  # a repeated batch replaces itself

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            grouped.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).foreachBatch(sink).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    latest = spark.read.parquet(updates).groupBy("digest").agg(F.max_by(F.struct("group_size", "keeper"), "batch").alias("s"))
    return latest.select("digest", F.col("s.keeper.doc_id").alias("keep_id"), F.col("s.keeper.place").alias("locator"), F.col("s.keeper.n_bytes").alias("n_bytes"), "s.group_size")


def _taken_in(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Adds rows that the content below root does not hold, and returns that content: as fingerprints, with its own places."""
    content = f"{root}/content"
    new = rows.select("doc_id", "text", "digest", "n_bytes")
    if exists(spark, content):
        known = spark.read.schema(new.schema).parquet(content).select("doc_id", "digest")
        new = new.alias("n").join(known.alias("k"), F.expr("n.digest = k.digest and n.doc_id <=> k.doc_id"), "left_anti")
    new.write.mode("append").parquet(content)
    held = with_place(spark, spark.read.schema(new.schema).parquet(content))
    return held.select("whole.*", "place")


def _dedup(spark: SparkSession, placed: DataFrame, scratch: Scratch, id_col: str, text_col: str, state_root: str | None) -> DataFrame:
    rows = fingerprints(placed, id_col, text_col)
    if state_root is None:
        root, held = scratch.root, rows
        files = f"{root}/fingerprints"
        rows.drop("text").write.parquet(files)
        own = prints = spark.read.schema(rows.drop("text").schema).parquet(files)
        stream = spark.readStream.schema(prints.schema).parquet(files)
    else:
        root, held = state_root, _taken_in(spark, rows, state_root)
        own = scratch.staged(rows.drop("text"), "fingerprints")
        prints = held.drop("text").join(own.select("digest").distinct(), "digest", "left_semi")
        files = spark.readStream.schema(held.drop("place").schema).parquet(f"{root}/content")
        stream = files.select("doc_id", "digest", "n_bytes", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))
    state = scratch.staged(keyed_state(spark, stream, root), "state")
    joined = own.drop("n_bytes").join(state.drop("n_bytes"), "digest")

    # the bytes: texts travel by their place, of which each is one, and meet the row that stays in a join that can be split
    several = state.filter("group_size > 1").select("digest", "locator")
    members = prints.select("digest", "doc_id", "place").join(several, "digest")
    texts = scratch.staged(held.select("place", "text").join(members, "place"), "hits")
    keepers = texts.filter("place = locator").select("locator", F.col("text").alias("keep_text"))
    differing = scratch.staged(texts.join(keepers, "locator").filter("text <> keep_text").select("digest"), "differing")
    if differing.isEmpty():
        return joined
    return _told_apart(joined, rows, texts, differing.distinct())


def _told_apart(joined: DataFrame, rows: DataFrame, texts: DataFrame, differing: DataFrame) -> DataFrame:
    """Splits the groups of digests that stand for several texts, by the text itself."""
    split = texts.join(differing, "digest", "left_semi").groupBy("digest", "text").agg(F.max(F.struct("doc_id", "place")).alias("k"), F.count(F.lit(1)).alias("group_size"))
    own = rows.join(differing, "digest", "left_semi").join(split, ["digest", "text"])
    apart = own.select("digest", "doc_id", "place", F.col("k.doc_id").alias("keep_id"), F.col("k.place").alias("locator"), "group_size")
    return joined.join(differing, "digest", "left_anti").select(apart.columns).unionByName(apart)


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_root: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, place, locator.

    Of equal texts the row with the largest id stays. ``locator`` finds its text: among the files of docs, or of
    ``state_root``. Joins on the digest are plain shuffled joins of narrow rows, whose hot partitions adaptive
    execution splits.
    """
    with Scratch(spark, "exact-dedup") as scratch:
        found = _dedup(spark, with_place(spark, docs), scratch, id_col, text_col, state_root)
        return staged(spark, found.select(
            "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "place", "locator",
        ), "exact-dedup-result")


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs with all their columns: of equal texts the one with the largest id, and of its repeated rows one."""
    with Scratch(spark, "exact-dedup") as scratch:
        placed = with_place(spark, docs)
        gone = staged(spark, _dedup(spark, placed, scratch, id_col, text_col, None).filter("place <> locator").select("place"), "exact-dedup-gone")
    return placed.join(gone, "place", "left_anti").select("whole.*")
