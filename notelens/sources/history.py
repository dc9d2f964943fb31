"""Revisions of notes from an exported log (SRC-16, SRC-17), so that no executor needs the version store itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.operators.resume import git_path

#: How the log is to be written: a zero byte and the day of each commit, then the names it touched, one to a line.
LOG_FORMAT = "git log --name-only --format=%x00%cs -- '*.md'"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """revisions(path, revised): each note and each day of a commit that touched it. Commits are records of their own,
    which the zero byte parts, so a log of any length is read in splits."""
    commits = spark.read.option("lineSep", "\0").text(path).filter("value <> ''")
    lines = F.split("value", "\n", -1)
    named = commits.select(F.try_to_date(F.trim(lines[0]), "yyyy-MM-dd").alias("revised"), F.explode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("name"))
    return named.filter("trim(name) <> ''").select(git_path(F.col("name")).alias("path"), "revised").distinct()


def last_revisions(revisions: DataFrame) -> DataFrame:
    """SRC-16: the last day each note was touched."""
    return revisions.groupBy("path").agg(F.max("revised").alias("revised"))
