"""The place of each row: the file it is read from and its number there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.sources.tables import staged


def _plain_scan(docs: DataFrame) -> bool:
    """Whether the rows are those of one file source, filtered and projected at most."""
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation" and "parquet" in node.toString().lower()


def with_place(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """whole (all columns of docs in one struct) and place (file, row). Rows that are not simply those of Parquet
    files are written to the shared folder first and have their places there."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    if "_metadata" in docs.columns or not _plain_scan(docs):
        docs, whole = staged(spark, docs.select(whole), "placed"), F.col("whole")
    return docs.select(whole, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))
