"""Streams that remember: jobs once by key, leases that run out, workers that fall silent.

State is keyed, lies in the RocksDB store and goes with the checkpoint; no table is read. Timers are of processing time: they
fire also in batches without data, while a query with a processing-time trigger runs.

Rows: a change without a path or a time, an event without a job and a beat without a worker or a time are left out. Repeated
rows change nothing; of rows for one key in a batch the latest counts, of equally late ones the greatest by their other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestone.operators import jobs as jb
from lodestone.session import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a job's key is remembered after it was seen.
REMEMBERED_MS = 30 * 86_400_000


def _micros(ts) -> int:
    return int(ts.timestamp() * 1_000_000)


def _ready(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


def start_once(writer: DataStreamWriter) -> StreamingQuery:
    """Starts a query that takes what there is and ends. State with a time to live asks for batches without data for ever, so these are off."""
    conf, name = writer._spark.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


class OnceByKey(StatefulProcessor):
    """Of a path's rows in a batch the last; nothing where its idempotency key was seen before."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "idempotency_key string", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r["ts"], str(r)))
        if not self.seen.containsKey((last["idempotency_key"],)):
            self.seen.updateValue((last["idempotency_key"],), (True,))
            yield last

    def close(self) -> None:
        pass


def once(changes: DataFrame, ttl_ms: int = REMEMBERED_MS) -> DataFrame:
    """The jobs of a stream of changes (path, ts, idempotency_key, ...): the last of each path in a batch, each key once.

    A key is remembered for ttl_ms; after that the queue's own anti-join (jobs.enqueue) is what leaves it out.
    """
    rows = _ready(changes).where("path IS NOT NULL AND ts IS NOT NULL AND idempotency_key IS NOT NULL")
    return rows.groupBy("path").transformWithState(OnceByKey(ttl_ms), rows.schema, "Append", "ProcessingTime")


class Leases(StatefulProcessor):
    """A timer for each lease that is held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "worker string, expires_us long, ts_us long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r["ts"], str(r)))
        before = self.held.get() if self.held.exists() else None
        if before is None or _micros(last["ts"]) >= before[2]:
            if before is not None and before[1] is not None:
                self.handle.deleteTimer(before[1] // 1000 + 1)
            lease = last["event"] == "leased" and last["lease_expires_at"] is not None
            expires = _micros(last["lease_expires_at"]) if lease else None
            self.held.update((last["worker"], expires, _micros(last["ts"])))  # kept also without a lease, against late rows
            if lease:
                self.handle.registerTimer(expires // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            worker, expires, _ = self.held.get()
            if expires is not None and expires // 1000 < expiredTimerInfo.getExpiryTimeInMs():
                self.held.clear()
                yield Row(job_id=key[0], worker=worker, change="lease_expired", lease_expires_us=expires)

    def close(self) -> None:
        pass


def expired_leases(events: DataFrame) -> DataFrame:
    """(job_id, worker, change, lease_expires_at) as soon as a lease has run out.

    events: job_id, event (`leased`, or anything that ends a lease), worker, lease_expires_at, ts. A later `leased` of the same job
    renews its lease.
    """
    rows = _ready(events).where("job_id IS NOT NULL AND ts IS NOT NULL").select("job_id", "event", "worker", "lease_expires_at", "ts")
    kind = rows.schema["job_id"].dataType.simpleString()
    out = rows.groupBy("job_id").transformWithState(Leases(), f"job_id {kind}, worker string, change string, lease_expires_us long", "Append", "ProcessingTime")
    return out.select("job_id", "worker", "change", F.timestamp_micros("lease_expires_us").alias("lease_expires_at"))


class Beats(StatefulProcessor):
    """The last beat, the counters so far, and a timer for the silence after it."""

    def __init__(self, stale_ms: int) -> None:
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen_us long, state string, ok long, bad long")

    def _row(self, key, seen: int, state: str, ok: int, bad: int) -> Row:
        return Row(worker_id=key[0], last_seen_us=seen, state=state, processed_count=ok, failed_count=bad)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get() if self.last.exists() else None
        seen, state, ok, bad = before or (None, None, 0, 0)
        found = sorted(rows, key=lambda r: (r["ts"], str(r)))
        ok, bad = ok + sum(r["ok"] or 0 for r in found), bad + sum(r["bad"] or 0 for r in found)
        if seen is None or _micros(found[-1]["ts"]) >= seen:
            if seen is not None:
                self.handle.deleteTimer(seen // 1000 + self.stale_ms + 1)
            seen, state = _micros(found[-1]["ts"]), found[-1]["state"]
            self.handle.registerTimer(seen // 1000 + self.stale_ms + 1)
        self.last.update((seen, state, ok, bad))
        yield self._row(key, seen, state, ok, bad)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            seen, _, ok, bad = self.last.get()
            if seen // 1000 + self.stale_ms < expiredTimerInfo.getExpiryTimeInMs():
                yield self._row(key, seen, "stale", ok, bad)

    def close(self) -> None:
        pass


def worker_states(beats: DataFrame, stale_seconds: float = jb.STALE_SECONDS) -> DataFrame:
    """(worker_id, last_seen_at, state, processed_count, failed_count): a row whenever a worker's changes, `stale` once it is silent for longer.

    beats: worker_id, ts, state, ok, bad (counts since the last beat). What jobs.workers() says at any time is a worker's last row.
    """
    rows = _ready(beats).where("worker_id IS NOT NULL AND ts IS NOT NULL").select("worker_id", "ts", "state", "ok", "bad")
    kinds = "worker_id string, last_seen_us long, state string, processed_count long, failed_count long"
    out = rows.groupBy("worker_id").transformWithState(Beats(int(stale_seconds * 1000)), kinds, "Update", "ProcessingTime")
    return out.select("worker_id", F.timestamp_micros("last_seen_us").alias("last_seen_at"), "state", "processed_count", "failed_count")
