"""Review queues (QRY, AGG and SRT rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses that end a project.
CLOSED = (
    "archived", "canceled", "cancelled", "closed", "completed", "done",
    "中止", "关闭", "取消", "完成", "已中止", "已关闭", "已取消", "已完成", "已归档", "已结束", "归档", "结束",
)

# Statuses of notes that are no project of their own.
NON_INSTANCE = ("template", "模板")


def _instances(projects: DataFrame) -> DataFrame:
    """Projects with their plain status and the day of their last activity; templates are none. Where type is known, only
    notes of type project are."""
    plain = F.coalesce(F.nullif(F.lower(F.trim("status")), F.lit("")), F.lit("unknown"))
    known = projects.filter(F.col("type") == "project") if "type" in projects.columns else projects
    return known.withColumn("status", plain).filter(~F.col("status").isin(*NON_INSTANCE)).withColumn("activity", F.coalesce("updated", "date"))


def project_issues(projects: DataFrame, as_of: str) -> DataFrame:
    """QRY-1: path, code, message of projects that the queue passes over: their activity is dated after the day."""
    late = _instances(projects).filter(F.col("activity") > F.lit(as_of).cast("date"))
    return late.select("path", F.lit("future-activity-date").alias("code"), F.concat(F.lit("activity date "), F.col("activity").cast("string"), F.lit(f" is after {as_of}")).alias("message"))


def queue_summary(projects: DataFrame, queue: DataFrame, as_of: str) -> DataFrame:
    """One row: projects (closed ones count), skipped (dated after the day) and candidates."""
    day = F.lit(as_of).cast("date")
    counted = _instances(projects).agg(F.count("*").alias("projects"), F.count_if(F.col("activity") > day).alias("skipped"), F.count_if(F.col("status").isin(*CLOSED)).alias("closed"))
    return counted.crossJoin(queue.agg(F.count("*").alias("candidates")))  # one row each


def project_queue(projects: DataFrame, tasks: DataFrame, as_of: str, stale_days: int = 30) -> DataFrame:
    """QRY-1 to QRY-4: projects that are blocked, undated or stale, with reasons, priority and next action.

    projects(path, status, updated, date); tasks(path, line, text, checked, in_next_actions). A project with
    tasks in a next-actions section counts and takes its next action from there; one without such a section
    from all its open tasks. One dated after the day is in ``project_issues``. Order (SRT-2): priority, oldest first, most tasks first, path.
    """
    day = F.lit(as_of).cast("date")
    opened = tasks.groupBy("path").agg(
        F.count_if(F.expr("not checked")).alias("open_tasks"), F.count_if(F.expr("not checked and in_next_actions")).alias("scoped"), F.bool_or("in_next_actions").alias("has_section"),
        F.min(F.when(~F.col("checked"), F.struct("line", "text"))).alias("any_first"), F.min(F.when(~F.col("checked") & F.col("in_next_actions"), F.struct("line", "text"))).alias("scoped_first"),
    )
    open_ = _instances(projects).filter(~F.col("status").isin(*CLOSED)).filter(F.col("activity").isNull() | (F.col("activity") <= day))
    aged = open_.withColumn("age_days", F.datediff(day, "activity")).filter((F.col("status") == "blocked") | F.col("activity").isNull() | (F.col("age_days") >= stale_days))
    joined = aged.join(opened, "path", "left")
    section = F.coalesce("has_section", F.lit(False))
    ranked = F.when(section, F.col("scoped")).otherwise(F.coalesce("open_tasks", F.lit(0)))
    priority = F.when(F.col("status") == "blocked", 0).when(F.col("activity").isNull(), 1).when(ranked > 0, 2).otherwise(3)
    reasons = F.array_compact(F.array(
        F.when(F.col("status") == "blocked", "blocked"), F.when(F.col("activity").isNull(), "missing-activity-date"),
        F.when(F.col("age_days") >= stale_days, F.concat(F.lit("stale:"), F.col("age_days").cast("string"), F.lit("-days"))),
        F.when(ranked > 0, F.concat(F.lit("open-tasks:"), ranked.cast("string"))),
    ))
    action = F.when(section, F.col("scoped_first.text")).otherwise(F.col("any_first.text"))
    return joined.select("path", "status", "age_days", F.coalesce("open_tasks", F.lit(0)).alias("open_tasks"), ranked.alias("ranking_tasks"), priority.alias("priority"), F.array_join(reasons, ",").alias("reasons"), action.alias("next_action"))


def queue_order(queue: DataFrame, limit: int) -> DataFrame:
    return queue.orderBy("priority", F.coalesce("age_days", F.lit(-1)).desc(), F.col("ranking_tasks").desc(), "path").limit(limit)


def open_loops(tasks: DataFrame, notes: DataFrame, board_type: str = "todo-board") -> DataFrame:
    """QRY-5: open tasks under an action heading, with the note's type and date; SRT-3 by date (none last), path, line.
    A board has its own queue, so its tasks are none of these."""
    kept = tasks.filter("not checked and in_next_actions and trim(text) <> ''")
    return kept.join(notes.filter(~F.col("type").eqNullSafe(board_type)).select("path", "type", "date"), "path").select("path", "line", "text", "type", "date")


def loop_summary(loops: DataFrame) -> DataFrame:
    """AGG-4: tasks and distinct notes by type, and over all (type 'all')."""
    summed = loops.rollup("type").agg(F.count(F.lit(1)).alias("loops"), F.count_distinct("path").alias("notes"), F.grouping("type").alias("g"))
    return summed.select(F.when(F.col("g") == 1, "all").otherwise(F.col("type")).alias("type"), "loops", "notes")


def cold_captures(captures: DataFrame, cold_after_days: int = 0) -> DataFrame:
    """QRY-7 and JN-11: captures(path, type, created, revised, modified) last touched no later than so many days
    after they were made. A revision date counts before a file time; evidence says which dated the row."""
    touched = F.coalesce("revised", "modified")
    dated = captures.withColumns({"touched": touched, "evidence": F.when(F.col("revised").isNotNull(), "git-history").otherwise("file-mtime")})
    return dated.withColumn("cold", F.datediff("touched", "created") <= cold_after_days)


def revisit_rates(dated: DataFrame) -> DataFrame:
    """AGG-5: captures, never reopened, and the rate of those that were, by type and over all (type 'all')."""
    every = dated.rollup("type").agg(F.count(F.lit(1)).alias("captures"), F.count_if("cold").alias("never_reopened"), F.grouping("type").alias("g"))
    rate = F.when(F.col("captures") > 0, F.round(1 - F.col("never_reopened") / F.col("captures"), 3))
    return every.select(F.when(F.col("g") == 1, "all").otherwise(F.col("type")).alias("type"), "captures", "never_reopened", rate.alias("revisit_rate"))
