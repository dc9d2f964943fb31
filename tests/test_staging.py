"""Staged content: bounds, refusals, and state that outlives a restart."""

from __future__ import annotations

import datetime
import hashlib

from notelens.streaming import staging

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC)
SHA = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(200)]


def entry(at_ms, size=10, seq=0):
    return {"at_ms": at_ms, "seq": seq, "vault": "v", "type": "t", "title": "n", "bytes": size}


def test_bounds():
    day = staging.EXPIRY_MS
    assert list(staging.pruned({"a": entry(0), "b": entry(1)}, day)) == ["b", "a"]
    assert list(staging.pruned({"a": entry(0), "b": entry(1)}, day + 1)) == ["b"]
    assert len(staging.pruned({str(i): entry(i) for i in range(100)}, 100)) == 64
    assert list(staging.pruned({"a": entry(0), "b": entry(1, staging.MAX_BYTES - 10)}, 1)) == ["b", "a"]
    assert list(staging.pruned({"a": entry(0), "b": entry(1, staging.MAX_BYTES - 9)}, 1)) == ["b"]
    assert staging.pruned({"a": entry(0, staging.MAX_BYTES + 1)}, 1) == {}


def test_answers():
    held = {SHA[0]: entry(0, seq=4)}
    ask = {"sha256": SHA[0], "vault": "v", "type": "t", "title": "n"}
    assert staging.answer(held, ask) == ("ok", None, 4)
    assert staging.answer(held, ask | {"sha256": SHA[1]}) == ("unknown-preflight-content", "sha256", None)
    assert staging.answer(held, ask | {"sha256": SHA[0].upper()})[0] == staging.answer(held, ask | {"sha256": None})[0] == "invalid-preflight-reference"
    assert staging.answer(held, ask | {"vault": "w", "type": "x"}) == ("preflight-vault-mismatch", "vault", 4)
    assert staging.answer(held, ask | {"type": "x"}) == ("preflight-context-mismatch", "type", 4)
    assert staging.answer(held, ask | {"type": "x", "title": None}) == ("preflight-context-mismatch", "type,title", 4)


def test_entries_outlive_a_restart_and_are_dropped_in_state(spark, tmp_path):
    source, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    at = lambda minutes: START + datetime.timedelta(minutes=minutes)
    row = lambda store, minutes, seq, kind, sha, size=10, kind_="t": (store, at(minutes), seq, kind, sha, "v", kind_, "n", size)
    first = [row(1, i, i, "stage", SHA[i]) for i in range(70)] + [row(2, 5, 500, "stage", SHA[0]), row(1, 80, 80, "load", SHA[0]), row(1, 81, 81, "load", SHA[6])]
    second = [row(1, 90, 90, "load", SHA[6]), row(1, 91, 91, "load", SHA[69], kind_="u"), row(2, 92, 501, "load", SHA[0]), row(1, 95, 92, "stage", SHA[6]), row(1, 96, 93, "stage", SHA[150], 31 << 20)]
    third = [row(1, 100, 100, "load", SHA[6]), row(1, 101, 101, "load", SHA[69]), row(1, 102, 102, "stage", SHA[151], 2 << 20), row(1, 103, 103, "load", SHA[6]), row(1, 104, 104, "load", SHA[150]), row(1, 105, 105, "load", SHA[151]),
             row(1, 2000, 200, "stage", "no hash"), row(1, 2001, 201, "load", SHA[151]), row(1, 2002, 202, "stage", SHA[9]), row(1, 2003, 203, "load", SHA[151])]
    for part in (first, second, third):
        spark.createDataFrame(part, staging.ASKED).write.mode("append").parquet(source)
        staging.follow_requests(spark, spark.readStream.schema(staging.ASKED).parquet(source), out, state)
    got = {r.seq: (r.code, r.differs, r.staged_seq) for r in spark.read.parquet(out).collect()}
    unknown = ("unknown-preflight-content", "sha256", None)
    assert got[80] == unknown and got[81] == ("ok", None, 6) == got[90]  # 64 of 70 stay
    assert got[91] == ("preflight-context-mismatch", "type", 69) and got[501] == ("ok", None, 500)
    assert got[100] == ("ok", None, 92) and got[101] == ("ok", None, 69)
    assert got[103] == unknown and got[104] == unknown and got[105] == ("ok", None, 102)  # 31 and 2 MiB pass the bound
    assert got[200][0] == "not-staged" and got[201] == ("ok", None, 102) and got[203] == unknown  # a day is over when next staged
