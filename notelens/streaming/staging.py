"""Content that was checked once, kept for a short time under its hash (SNK-5, MSC-11 of the inventory).

Each store is a key of the stream, its entries are map state by hash. Staging writes an entry over an older one of its hash
and then drops what is older than a day, beyond the 64 newest, or beyond 32 MiB counted from the newest on; so state is
bounded for each store. A load finds the entry of its hash, or tells why it does not stand for what was asked: the hash is
none, nothing is known of it, it was staged for another vault, or for another type or title, and which of them differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from notelens.streaming.board import keyed_state

EXPIRY_MS, MAX_ENTRIES, MAX_BYTES = 86_400_000, 64, 32 << 20
HASH = re.compile(r"[0-9a-f]{64}")
ASKED = "store long, at timestamp, seq long, kind string, sha256 string, vault string, type string, title string, bytes long"
ANSWERS = "store long, at_ms long, seq long, kind string, sha256 string, code string, differs string, staged_seq long"
ENTRY = "at_ms long, seq long, vault string, type string, title string, bytes long"
FIELDS = tuple(c.split()[0] for c in ENTRY.split(", "))


def pruned(entries: dict[str, dict], now_ms: int) -> dict[str, dict]:
    """What a store keeps at a time, newest first."""
    kept, left = {}, MAX_BYTES
    for sha, e in sorted(entries.items(), key=lambda x: (x[1]["at_ms"], x[1]["seq"]), reverse=True):
        if now_ms - e["at_ms"] > EXPIRY_MS:
            break
        left -= e["bytes"]
        if len(kept) == MAX_ENTRIES or left < 0:
            break
        kept[sha] = e
    return kept


def answer(entries: dict[str, dict], ask: dict) -> tuple[str, str | None, int | None]:
    """(code, fields that differ, number of the staging) for a load; the code of one that finds its content is ok."""
    if not HASH.fullmatch(ask["sha256"] or ""):
        return "invalid-preflight-reference", None, None
    entry = entries.get(ask["sha256"])
    if entry is None:
        return "unknown-preflight-content", "sha256", None
    if entry["vault"] != ask["vault"]:
        return "preflight-vault-mismatch", "vault", entry["seq"]
    differs = [f for f in ("type", "title") if entry[f] != ask[f]]
    return ("preflight-context-mismatch", ",".join(differs), entry["seq"]) if differs else ("ok", None, entry["seq"])


class StagedContent(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "sha256 string", ENTRY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = {k[0]: dict(zip(FIELDS, v, strict=True)) for k, v in self.entries.iterator()}
        entries, out = dict(before), []
        for r in pd.concat(list(rows)).sort_values(["at_ms", "seq"], kind="stable").to_dict("records"):
            if r["kind"] == "load":
                code, differs, staged = answer(entries, r)
            elif HASH.fullmatch(r["sha256"] or ""):
                entries[r["sha256"]] = {f: r[f] for f in FIELDS}
                entries = pruned(entries, r["at_ms"])
                code, differs, staged = "staged", None, r["seq"]
            else:
                code, differs, staged = "not-staged", None, None
            out.append((key[0], r["at_ms"], r["seq"], r["kind"], r["sha256"], code, differs, staged))
        for sha in before.keys() - entries.keys():
            self.entries.removeKey((sha,))
        for sha, e in entries.items():
            if before.get(sha) != e:
                self.entries.updateValue((sha,), tuple(e[f] for f in FIELDS))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])
        yield frame.astype({"staged_seq": "Int64"})

    def close(self) -> None:
        pass


def answers(requests: DataFrame) -> DataFrame:
    """A row for each request of a stream of requests (as ASKED; kind is stage or load); requests come in order of time."""
    plain = requests.select("store", F.unix_millis("at").alias("at_ms"), "seq", "kind", "sha256", "vault", "type", "title", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return plain.groupBy("store").transformWithStateInPandas(StagedContent(), ANSWERS, "Append", "None")


def follow_requests(spark: SparkSession, requests: DataFrame, out: str, checkpoint: str) -> None:
    """Answers what is there of a stream of requests, from where the checkpoint stands, and appends the answers to out."""
    with keyed_state(spark):
        query = answers(requests).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path=out, format="parquet")
        query.awaitTermination()
