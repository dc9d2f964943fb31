"""Boards as keyed state: equal to the plan over the whole table, also after a restart from the checkpoint."""

from __future__ import annotations

import datetime
import random

import pytest
from notelens.operators import boards, workflow
from notelens.streaming import board
from pyspark.sql import functions as F

KIND = "board long, item string, at timestamp, seq long, action string, due date"
START = datetime.datetime(2024, 3, 1, 8, tzinfo=datetime.UTC)


def actions(n=400, seed=3):
    rng = random.Random(seed)
    at, out = START, []
    for seq in range(n):
        at += datetime.timedelta(minutes=rng.choice([0, 1, 30, 200]))
        due = rng.choice([None, at.date() + datetime.timedelta(days=rng.randint(-1, 6))])
        out.append((rng.randint(1, 3), rng.choice(["call", "Call", "pay  rent", "读"]), at, seq, rng.choice(board.ACTIONS), due))
    return out


def brute(rows):
    """Each board held as a list of rows, one action after the other, with the clock moved on day by day."""
    out, state = [], {}
    end = max(r[2] for r in rows)

    def midnights(key, now):
        due, section = state[key]
        if section == boards.OPEN[1] and (at := datetime.datetime(due.year, due.month, due.day, tzinfo=datetime.UTC)) <= now:
            state[key] = (due, boards.OPEN[0])
            out.append((*key, at, None, "rebucket", "ok", boards.OPEN[0], None))

    for b, item, at, seq, action, due in sorted(rows, key=lambda r: (r[2], r[3])):
        key = (b, item)
        if key in state:
            midnights(key, at)
        if action == "capture" and key in state:
            got = ("board-duplicate", None, None)
        elif action != "capture" and key not in state:
            got = ("board-no-match", None, None)
        elif action in ("tick", "cancel"):
            del state[key]
            got = ("ok", boards.SECTIONS[4], boards.TICKED if action == "tick" else boards.CANCELLED)
        else:
            section = boards.spoken(due and due.isoformat(), at.date().isoformat())
            state[key] = (due, section)
            got = ("ok", section, None)
        out.append((b, item, at, seq, action, *got))
    for key in list(state):
        midnights(key, end)
    return sorted(out, key=repr)


def as_rows(df):
    got = df.select("board", "item", F.unix_millis("at").alias("ms") if "at" in df.columns else F.col("at_ms").alias("ms"), "seq", "action", "code", "section", "mark").collect()
    return sorted(((r.board, r.item, datetime.datetime.fromtimestamp(r.ms / 1000, datetime.UTC), r.seq, r.action, r.code, r.section, r.mark) for r in got), key=repr)


def test_log_of_a_table_equals_a_plain_fold(spark):
    rows = actions()
    got = as_rows(workflow.board_log(spark.createDataFrame(rows, KIND).repartition(3)))
    assert got == brute(rows)
    assert {r[5] for r in got} == {"ok", "board-duplicate", "board-no-match"} and any(r[4] == "rebucket" for r in got)


def test_stream_equals_the_table_after_a_restart(spark, tmp_path):
    rows = actions(240, 8)
    source, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    for part in (rows[:100], rows[100:180], rows[180:]):
        spark.createDataFrame(part, KIND).write.mode("append").parquet(source)
        board.follow_boards(spark, spark.readStream.schema(KIND).parquet(source), out, state)
    got = as_rows(spark.read.parquet(out))
    want = brute(rows)
    assert got == want


def test_repeated_actions_are_refused_and_older_ones_left_out(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    rows = actions(30, 1)
    late = (1, "new text", START - datetime.timedelta(days=1), 99, "capture", None)
    for part in (rows, [rows[-1], late]):
        spark.createDataFrame(part, KIND).write.mode("append").parquet(source)
        board.follow_boards(spark, spark.readStream.schema(KIND).parquet(source), out, state)
    got = spark.read.parquet(out)
    assert sorted(r.code == "board-late" for r in got.filter(F.col("seq") == rows[-1][3]).collect()) == [False, True]
    assert got.filter("seq = 99").isEmpty()


@pytest.mark.parametrize("due,day,section", [(None, 10, 2), (10, 10, 0), (9, 10, 0), (11, 10, 1)])
def test_sections(due, day, section):
    assert board._place(due, day) == boards.OPEN[section]
