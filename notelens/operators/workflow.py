"""Inbox, board, retention, receipts and evaluation (QRY, WIN, SET and AGG rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords that route a note of unknown type, first match first.
KEYWORD_ROUTES = (
    (("meeting", "standup", "review", "sync"), "10-Work"),
    (("article", "learning", "book", "course", "tutorial"), "20-Learning"),
    (("web", "url", "blog", "clip"), "20-Learning"),
    (("analysis", "insight", "idea", "takeaway"), "30-Insights"),
    (("project", "milestone", "sprint"), "40-Projects"),
    (("person", "contact", "team"), "50-People"),
)


def inbox_target(kind: Column, text: Column, folders: dict[str, str], routes=KEYWORD_ROUTES) -> Column:
    """QRY-19: the folder of the type, else of the first route with a keyword in the text."""
    out = F.lit(None).cast("string")
    for words, folder in reversed(routes):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(text), F.lit(w))
        out = F.when(hit, folder).otherwise(out)
    for name, folder in folders.items():
        out = F.when(kind == name, folder).otherwise(out)
    return out


def inbox_plan(items: DataFrame, folders: dict[str, str], routes=KEYWORD_ROUTES) -> DataFrame:
    """QRY-18 and FLT-7: items(path, type, text, readable, tags) with target and skip_code, the first that holds:
    unreadable, draft (a draft tag or a placeholder left), unknown-target."""
    draft = F.exists("tags", lambda t: F.lower(F.trim(t)) == "incomplete") | F.col("text").rlike(r"\{\{[^{}]*\}\}")
    target = inbox_target(F.col("type"), F.col("text"), folders, routes)
    code = F.when(~F.col("readable"), "unreadable").when(draft, "draft").when(target.isNull(), "unknown-target")
    return items.select("path", target.alias("target"), code.alias("skip_code"))


def retention(backups: DataFrame, keep: int, protected: Column | None = None) -> DataFrame:
    """WIN-2: of the backups of each note the newest ``keep`` stay; protected ones sort first. Order: protected,
    time, stamp, path, all descending. backups(path, relative_note, stamp, mtime). A keep below 1 deletes nothing."""
    first = protected if protected is not None else F.lit(False)
    order = Window.partitionBy("relative_note").orderBy(first.desc(), F.col("mtime").desc(), F.col("stamp").desc(), F.col("path").desc())
    return backups.withColumn("place", F.row_number().over(order)).withColumn("deleted", F.lit(keep >= 1) & (F.col("place") > keep))


def cache_prune(entries: DataFrame, max_entries: int, max_bytes: int, oldest: Column) -> DataFrame:
    """WIN-11: newest first within each cache; entries before ``oldest`` go, then those beyond the count or the
    bytes. entries(cache, key, staged, bytes) with kept. Sums by hour find the one hour of a cache in which the bounds are
    passed; only its entries are put in order."""
    live = entries.filter(F.col("staged") >= oldest).withColumn("_hour", F.date_trunc("hour", "staged"))
    newer = Window.partitionBy("cache").orderBy(F.col("_hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    hours = live.groupBy("cache", "_hour").agg(F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_b"))
    hours = hours.withColumns({"_n0": F.coalesce(F.sum("_n").over(newer), F.lit(0)), "_b0": F.coalesce(F.sum("_b").over(newer), F.lit(0))})
    whole = (F.col("_n0") + F.col("_n") <= max_entries) & (F.col("_b0") + F.col("_b") <= max_bytes)
    partly = ~whole & (F.col("_n0") < max_entries) & (F.col("_b0") <= max_bytes)
    placed = live.join(hours.withColumns({"_whole": whole, "_partly": partly}), ["cache", "_hour"])
    order = Window.partitionBy("cache").orderBy(F.col("staged").desc(), "key")
    running = F.col("_b0") + F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    bounds = placed.filter("_partly").withColumn("kept", (F.col("_n0") + F.row_number().over(order) <= max_entries) & (running <= max_bytes))
    clear = placed.filter("not _partly").withColumn("kept", F.col("_whole"))
    return clear.unionByName(bounds).select(*entries.columns, "kept")


def log_cap(log: DataFrame, keep: int = 30) -> DataFrame:
    """WIN-9: the last entries of each log; log(path, line, text)."""
    order = Window.partitionBy("path").orderBy(F.col("line").desc())
    return log.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).drop("place")


def spoken_section(due: Column, today: Column) -> Column:
    """QRY-15: the section of a board that an open item belongs to on the day."""
    from notelens.operators.boards import OPEN

    return F.when(due.isNull(), OPEN[2]).when(due <= today, OPEN[0]).otherwise(OPEN[1])


def board_view(items: DataFrame, today: str) -> DataFrame:
    """QRY-14: items(id, section, due, done) with the section they belong to and whether they stand elsewhere."""
    from notelens.operators.boards import SECTIONS

    spoken = F.when(F.col("done"), SECTIONS[4]).otherwise(spoken_section(F.col("due"), F.lit(today).cast("date")))
    return items.withColumn("spoken", spoken).withColumn("misplaced", F.col("section") != F.col("spoken"))


def board_fold(events: DataFrame) -> DataFrame:
    """QRY-16 as a fold: events(board, item, at, seq, action) with actions capture, tick, cancel, reschedule. The
    last event tells an item's state; a capture of an open item again is refused as duplicate, and any other
    action before its first capture as no-match."""
    order = Window.partitionBy("board", "item").orderBy("at", "seq")
    captures = F.sum(F.when(F.col("action") == "capture", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag("action").over(order)
    code = F.when((F.col("action") == "capture") & before.isin("capture", "reschedule"), "duplicate").when((F.col("action") != "capture") & (F.coalesce(captures, F.lit(0)) == 0), "no-match").otherwise("ok")
    judged = events.withColumn("code", code)
    return judged.groupBy("board", "item").agg(
        F.max(F.struct("at", "seq", "action")).alias("last"), F.count_if(F.expr("code = 'duplicate'")).alias("duplicates"), F.count_if(F.expr("code = 'no-match'")).alias("no_match"),
    ).select("board", "item", F.col("last.action").alias("last_action"), F.when(F.col("last.action") == "tick", "done").when(F.col("last.action") == "cancel", "cancelled").otherwise("open").alias("state"), "duplicates", "no_match")


def board_log(actions: DataFrame) -> DataFrame:
    """QRY-15, QRY-16, JN-18 over a whole table of actions(board, item, at, seq, action, due) with actions capture, reschedule,
    tick and cancel: board, item, at, seq, action, code, section and mark of each, and a row "rebucket" where an open row
    comes to its day before anything else happens to it, or before the last action of the table. The exact text is the key: a capture of an open one is
    board-duplicate, anything else on one that is not open board-no-match. A row is open if the last action on it other
    than a reschedule was a capture, refused or not, so no fold is needed. Days are those of UTC."""
    from notelens.operators.boards import CANCELLED, OPEN, SECTIONS, TICKED

    order = Window.partitionBy("board", "item").orderBy("at", "seq")
    turning = F.last(F.when(F.col("action") != "reschedule", F.col("action")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.coalesce(turning == "capture", F.lit(False))
    code = F.when((F.col("action") == "capture") & opened, "board-duplicate").when((F.col("action") != "capture") & ~opened, "board-no-match").otherwise("ok")
    day = F.floor(F.unix_millis("at") / 86_400_000)
    spoken = F.when(F.col("due").isNull(), OPEN[2]).when(F.unix_date("due") <= day, OPEN[0]).otherwise(OPEN[1])
    placing = F.col("action").isin("capture", "reschedule")
    section = F.when(F.col("code") == "ok", F.when(placing, spoken).otherwise(SECTIONS[4]))
    mark = F.when(F.col("code") == "ok", F.when(F.col("action") == "tick", TICKED).when(F.col("action") == "cancel", CANCELLED))
    judged = actions.withColumn("code", code).withColumns({"section": section, "mark": mark})
    taken = judged.filter("code = 'ok'").withColumn("_next", F.lead("at").over(order))
    end = actions.agg(F.max("at").alias("_end"))  # one row
    moved = taken.filter(placing & (F.col("section") == OPEN[1])).crossJoin(F.broadcast(end))
    moved = moved.withColumn("_day", F.timestamp_millis(F.unix_date("due").cast("long") * 86_400_000)).filter(F.coalesce(F.col("_day") <= F.col("_next"), F.col("_day") < F.col("_end")))
    moved = moved.select("board", "item", F.col("_day").alias("at"), F.lit(None).cast("long").alias("seq"), F.lit("rebucket").alias("action"), F.lit("ok").alias("code"), F.lit(OPEN[0]).alias("section"), F.lit(None).cast("string").alias("mark"))
    return judged.select("board", "item", "at", "seq", "action", "code", "section", "mark").unionByName(moved)


def budget_skip(folders: list[tuple[str, int]], budget: int) -> list[str]:
    """WIN-7: folders in order, each taken if its cost still fits; a costly one is passed over, not the end."""
    taken = []
    for name, cost in folders:
        if cost <= budget:
            taken.append(name)
            budget -= cost
    return taken


def uncovered_spans(spans: DataFrame, excerpts: DataFrame) -> DataFrame:
    """JN-13: spans(doc, start, end) that no excerpt span of the same document contains."""
    inside = F.expr("s.doc = e.doc and s.start >= e.start and s.end <= e.end")
    return spans.alias("s").join(excerpts.alias("e"), inside, "left_anti")


def missing_kinds(items: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """SET-4: required kinds that a group lacks; items(path, kind)."""
    held = items.groupBy("path").agg(F.collect_set("kind").alias("kinds"))
    return held.select("path", F.array_sort(F.array_except(F.array(*map(F.lit, required)), "kinds")).alias("missing"))


def sources_union(parts: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """SET-1 and SRT-8: sources (path, date) of several origins, each with its trust (smaller is more); a path
    counts once, with its best trust and all its origins."""
    tagged = [df.select("path", "date", F.lit(trust).alias("trust"), F.lit(origin).alias("origin")) for origin, trust, df in parts]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return every.groupBy("path").agg(F.min("trust").alias("trust"), F.max("date").alias("date"), F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origins"))


def evaluate(results: DataFrame, cases: DataFrame, at: int = 5) -> DataFrame:
    """AGG-17 and JN-19: results(id, path, rank), cases(id, group, expected). For each group recall at k, mean
    reciprocal rank, and for cases without expected paths the rate of those that return anything."""
    hit = results.join(cases.select("id", F.explode("expected").alias("path")), ["id", "path"]).groupBy("id").agg(F.min("rank").alias("rank"))
    returned = results.groupBy("id").agg(F.count(F.lit(1)).alias("returned"))
    joined = cases.join(hit, "id", "left").join(returned, "id", "left").withColumn("answerable", F.size("expected") > 0)
    return joined.groupBy("group").agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.when(F.col("answerable"), F.when(F.col("rank") <= at, 1.0).otherwise(0.0))), 4).alias("recall"),
        F.round(F.avg(F.when(F.col("answerable"), F.coalesce(1 / F.col("rank"), F.lit(0.0)))), 4).alias("mrr"),
        F.round(F.avg(F.when(~F.col("answerable"), F.when(F.col("returned") > 0, 1.0).otherwise(0.0))), 4).alias("false_positive_rate"),
    )


def nearest_rank(df: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """AGG-18: of n sorted values the one at place ceil(n share), at least the first."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))  # a row for each value goes on
    order = Window.partitionBy(by).orderBy(value)
    ranked = counted.withColumns({"_upto": F.sum("_c").over(order), "_n": F.sum("_c").over(Window.partitionBy(by))})
    return ranked.groupBy(by).agg(*[F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("_n") * s), F.lit(1)), F.col(value))).alias(f"p{round(100 * s)}") for s in shares])


def family_occupancy(results: DataFrame, families: DataFrame) -> DataFrame:
    """AGG-20: how many of the results of a case each family takes; results(id, path), families(path, family)."""
    return results.join(families, "path").groupBy("id", "family").agg(F.count(F.lit(1)).alias("places"))


def case_report(cases: DataFrame, results: DataFrame, must_see: DataFrame, hard: DataFrame, expected: DataFrame, at: int = 5) -> DataFrame:
    """AGG-19, one row for each case(id, group): rank of the first expected path, results returned, required paths that
    are not among them and hard negatives that are. results(id, path, rank); the others (id, path)."""
    held = results.filter(F.col("rank") <= at).select("id", "path", "rank")
    ranks = held.join(expected, ["id", "path"]).groupBy("id").agg(F.min("rank").alias("rank"))
    returned = held.groupBy("id").agg(F.count(F.lit(1)).alias("returned"))
    missing = must_see.distinct().join(held, ["id", "path"], "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("must_see_missing"))
    hits = hard.distinct().join(held, ["id", "path"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("hard_negative_hits"))
    out = cases.select("id", "group")
    for part in (ranks, returned, missing, hits):
        out = out.join(part, "id", "left")
    return out.fillna(0, ["returned", "must_see_missing", "hard_negative_hits"])


def case_groups(report: DataFrame, unanswerable: str = "no-answer") -> DataFrame:
    """AGG-19: the report by group and over all (group 'all'): recall and MRR of answerable cases, false positives of the
    others, and the cases that show a limitation."""
    summed = report.withColumn("open", F.col("group") != unanswerable).rollup("group").agg(
        F.grouping("group").alias("g"), F.count(F.lit(1)).alias("cases"),
        F.round(F.avg(F.when(F.col("open"), F.col("rank").isNotNull().cast("double"))), 3).alias("recall"),
        F.round(F.avg(F.when(F.col("open"), F.coalesce(1 / F.col("rank"), F.lit(0.0)))), 3).alias("mrr"),
        F.sum("must_see_missing").alias("must_see_misses"), F.sum("hard_negative_hits").alias("hard_negative_hits"),
        F.round(F.avg(F.when(~F.col("open"), (F.col("returned") > 0).cast("double"))), 3).alias("false_positive_rate"),
        F.count_if((F.col("must_see_missing") > 0) | (F.col("hard_negative_hits") > 0)).alias("limited"),
    )
    return summed.withColumn("group", F.when(F.col("g") == 1, "all").otherwise(F.col("group"))).drop("g")


def memos(rows: DataFrame) -> DataFrame:
    """SRT-13: notes of a board, the latest first; rows(at, line, text), at may be null."""
    return rows.orderBy(F.coalesce("at", F.lit("")).desc(), F.col("line").desc())


def as_payload(rows: DataFrame) -> DataFrame:
    """SNK-1: each row as one JSON text (payload), null fields kept."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("payload"))
