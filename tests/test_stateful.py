"""Streams with state: restarts, timers that fire, keys that are forgotten."""

import datetime as dt
import json
import os
import time

import pytest

from lodestone.streaming import changes as cs
from lodestone.streaming import stateful as st


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("\n".join(json.dumps(r, default=str) for r in rows))
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def until(spark, query, name, test, seconds=90):
    """The rows of a memory table once they pass a test."""
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        rows = spark.table(name).collect()
        if test(rows):
            return rows
        time.sleep(0.3)
    pytest.fail(f"{spark.table(name).collect()}")


def test_jobs_once_over_restarts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "jobs")
    change = {"path": "a", "change": "modified", "ts": "2024-01-01T00:00:00Z", "size_bytes": 1, "mtime_ns": 7, "seen": True}
    turns = [
        [change, {**change, "path": "b", "seen": False}, change],
        [{**change, "ts": "2024-01-01T00:00:09Z"}, {**change, "path": None}, {**change, "ts": None}],  # seen in an earlier batch
        [{**change, "mtime_ns": 8, "ts": "2024-01-02T00:00:00Z"}, {**change, "mtime_ns": 9, "ts": "2024-01-03T00:00:00Z"}],  # the last of a path
        [{**change, "mtime_ns": 8, "ts": "2024-01-02T00:00:00Z"}, {**change, "path": "b", "seen": False, "ts": "2024-01-05T00:00:00Z"}],
    ]
    found = []
    for k, rows in enumerate(turns):
        put(src, f"{k}.json", rows)
        cs.enqueue_stream(cs.change_stream(spark, src), out, str(tmp_path / "check"), available_now=True).awaitTermination()
        found.append(sorted((r["path"], r["job_type"], r["mtime_ns"]) for r in spark.read.parquet(out).collect()))
    first = [("a", "watch_index", 7), ("b", "watch_delete", 7)]
    assert found[0] == found[1] == first and found[2] == sorted([*first, ("a", "watch_index", 9)])
    assert found[3] == sorted([*found[2], ("a", "watch_index", 8), ("b", "watch_delete", 7)])  # another key each


def test_leases_run_out(spark, tmp_path):
    src, now = str(tmp_path / "in"), dt.datetime.now(dt.UTC)
    at = lambda s: (now + dt.timedelta(seconds=s)).isoformat()
    event = lambda job, kind, expires=None, s=0: {"job_id": job, "event": kind, "worker": "w", "lease_expires_at": expires and at(expires), "ts": at(s)}
    put(src, "1.json", [event("gone", "leased", -5), event("held", "leased", 3600), event("soon", "leased", 20), event("done", "leased", 20), event("renewed", "leased", 20), event("ended", "leased", -5), event("ended", "finished", s=1), event(None, "leased", -5)])
    events = spark.readStream.schema("job_id string, event string, worker string, lease_expires_at timestamp, ts timestamp").json(src)
    query = st.expired_leases(events).writeStream.format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        until(spark, query, "leases", lambda rows: {r["job_id"] for r in rows} == {"gone"})
        put(src, "2.json", [event("done", "finished", s=1), event("renewed", "leased", 7200, s=1), event("renewed", "leased", 1, s=-9)])
        rows = until(spark, query, "leases", lambda rows: {r["job_id"] for r in rows} >= {"gone", "soon"})
        assert {r["job_id"] for r in rows} == {"gone", "soon"} and all(r["change"] == "lease_expired" and r["worker"] == "w" for r in rows)
    finally:
        query.stop()


def test_silent_workers_are_stale(spark, tmp_path):
    src, now = str(tmp_path / "in"), dt.datetime.now(dt.UTC)
    beat = lambda w, s, state, ok=1, bad=0: {"worker_id": w, "ts": (now + dt.timedelta(seconds=s)).isoformat(), "state": state, "ok": ok, "bad": bad}
    put(src, "1.json", [beat("old", -9999, "idle", 5), beat("a", 0, "idle", 2), beat("a", -1, "busy", 3, 1), beat("live", 3600, "busy")])
    beats = spark.readStream.schema("worker_id string, ts timestamp, state string, ok long, bad long").json(src)
    start = lambda: st.worker_states(beats, 15).writeStream.format("memory").queryName("beats").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    query = start()
    try:
        rows = until(spark, query, "beats", lambda rows: {("old", "stale"), ("a", "stale")} <= {(r["worker_id"], r["state"]) for r in rows})
        assert [(r["processed_count"], r["failed_count"]) for r in rows if r["worker_id"] == "a"] == [(5, 1), (5, 1)] and not [r for r in rows if (r["worker_id"], r["state"]) == ("live", "stale")]
    finally:
        query.stop()
