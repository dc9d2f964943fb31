"""Streaming extensions: notes and events as streams, windows over events, and boards as keyed state.

``BoardRows`` follows every row of a board (QRY-15, QRY-16, JN-18): its key is the board and the exact text, its state whether
the row stands open, where, and until when. Each action gives one row of the result, refused ones with their code; a timer
moves an open row to today's section when its day comes, without an action. ``workflow.board_log`` is the same as a plan over
a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from notelens.operators.boards import CANCELLED, OPEN, SECTIONS, TICKED

DAY_MS = 86_400_000
ACTIONS = ("capture", "reschedule", "tick", "cancel")
ROWS = "board long, item string, at_ms long, seq long, action string, code string, section string, mark string"
STATE = "open boolean, due_day long, section string, last_ms long, last_seq long"
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """events as a stream of Parquet files, with a timestamp that windows can use."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events of each type in hours of event time; hours close once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def board_state(events: DataFrame) -> DataFrame:
    """QRY-16 on a stream: the last action of each item as keyed state, in update mode."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy("user_id").agg(last.alias("last"), F.count(F.lit(1)).alias("actions")).select("user_id", F.col("last.event_type").alias("last_type"), "actions")


def _place(due_day: int | None, day: int) -> str:
    return OPEN[2] if due_day is None else OPEN[0] if due_day <= day else OPEN[1]


class BoardRows(StatefulProcessor):
    """One row of one board. Actions of one batch are taken in their order; batches follow each other in time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", STATE)

    def _load(self) -> dict:
        if not self.row.exists():
            return {"open": False, "due_day": None, "section": None, "last_ms": -1, "last_seq": -1}
        return dict(zip(("open", "due_day", "section", "last_ms", "last_seq"), self.row.get(), strict=True))

    def _save(self, state: dict) -> None:
        self.row.update((state["open"], state["due_day"], state["section"], state["last_ms"], state["last_seq"]))

    def _due(self, key: tuple, state: dict, now_ms: int) -> dict | None:
        """The move to today's section, where its midnight has come."""
        if not state["open"] or state["section"] != OPEN[1] or state["due_day"] * DAY_MS > now_ms:
            return None
        state["section"] = OPEN[0]
        return {"board": key[0], "item": key[1], "at_ms": state["due_day"] * DAY_MS, "seq": None, "action": "rebucket", "code": "ok", "section": OPEN[0], "mark": None}

    def _act(self, key: tuple, state: dict, event: dict) -> dict:
        at, seq, action = event["at_ms"], event["seq"], event["action"]
        due = None if pd.isna(event["due_day"]) else int(event["due_day"])
        out = {"board": key[0], "item": key[1], "at_ms": at, "seq": seq, "action": action, "code": "ok", "section": None, "mark": None}
        if (at, seq) <= (state["last_ms"], state["last_seq"]):
            return out | {"code": "board-late"}
        state["last_ms"], state["last_seq"] = at, seq
        if action == "capture" and state["open"]:
            return out | {"code": "board-duplicate"}
        if action != "capture" and not state["open"]:
            return out | {"code": "board-no-match"}
        if action in ("capture", "reschedule"):
            section = _place(due, at // DAY_MS)
            state.update(open=True, due_day=due, section=section)
            return out | {"section": section}
        state.update(open=False, due_day=None, section=None)
        return out | {"section": SECTIONS[4], "mark": TICKED if action == "tick" else CANCELLED}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = self._load(), []
        events = pd.concat(list(rows)).sort_values(["at_ms", "seq"], kind="stable")
        for event in events.to_dict("records"):
            if event["action"] not in ACTIONS:
                raise ValueError(f"no action of a board: {event['action']!r}")
            moved = self._due(key, state, event["at_ms"])
            out += ([moved] if moved else []) + [self._act(key, state, event)]
        self._save(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if state["open"] and state["section"] == OPEN[1]:
            self.handle.registerTimer(state["due_day"] * DAY_MS)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._load()
        moved = self._due(key, state, expiredTimerInfo.getExpiryTimeInMs())
        if moved:
            self._save(state)
            yield _frame([moved])

    def close(self) -> None:
        pass


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])
    return out.astype({"board": "int64", "at_ms": "int64", "seq": "Int64"})


def board_rows(actions: DataFrame) -> DataFrame:
    """QRY-16 on a stream of actions(board, item, at, seq, action, due): a row for each action and each move, in append mode.
    Days are those of UTC. Actions come in order of time: the watermark stands a millisecond behind the last one, older ones
    are left out, and one that has been taken already is board-late."""
    keyed = actions.withWatermark("at", "1 millisecond").select("board", "item", "at", "seq", "action", F.unix_millis("at").alias("at_ms"), F.unix_date("due").cast("long").alias("due_day"))
    return keyed.groupBy("board", "item").transformWithStateInPandas(BoardRows(), ROWS, "Append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The settings that arbitrary state needs, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def follow_boards(spark: SparkSession, actions: DataFrame, out: str, checkpoint: str) -> None:
    """Takes in what is there of a stream of actions, from where the checkpoint stands, and appends its rows to out."""
    with keyed_state(spark):
        query = board_rows(actions).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path=out, format="parquet")
        query.awaitTermination()
