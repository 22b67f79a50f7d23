"""The ingest queue as tables: enqueue, lease, fail, finish, retry, heartbeats.

Spark has no row locks: one writer applies a batch of these column updates, and exactly-once comes
from idempotency keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
BACKOFF_CAP = 300
STALE_SECONDS = 45
ERROR_CHARS = 4000
STATES = ["pending", "leased", "processing", "succeeded", "failed", "dead_letter", "cancelled"]


def backoff_seconds(attempt: Column) -> Column:
    """2, 4, 8, ... seconds by attempt, at most BACKOFF_CAP."""
    return F.least(F.lit(BACKOFF_CAP), F.lit(2) * F.pow(F.lit(2), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(20)))).cast("int")


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` whose idempotency key no job has yet, one for each key."""
    return new.dropDuplicates(["idempotency_key"]).join(jobs.select("idempotency_key"), "idempotency_key", "left_anti")


def eligible(now: Column) -> Column:
    """Whether a job may be leased. Jobs without attempts left never are, expired or not."""
    ready = F.col("status").isin("pending", "failed") & (F.col("available_at") <= now)
    lapsed = F.col("status").isin("leased", "processing") & (F.col("lease_expires_at") < now)
    return (ready | lapsed) & (F.col("attempt_count") < F.col("max_attempts"))


LEASE_ORDER = ["priority", "available_at", "created_at", "job_id"]


def lease_candidates(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    return jobs.where(eligible(now)).orderBy(*LEASE_ORDER).limit(limit)


def lease(jobs: DataFrame, worker: str, now: Column, seconds: int, limit: int = 1) -> DataFrame:
    """All jobs, the next `limit` of them leased by `worker`."""
    taken = lease_candidates(jobs, now, limit).select("job_id", F.lit(True).alias("_take"))  # `limit` rows
    on = F.col("_take").isNotNull()
    out = jobs.join(F.broadcast(taken), "job_id", "left")
    changed = {
        "status": F.lit("leased"), "leased_by": F.lit(worker), "lease_expires_at": F.timestamp_add("SECOND", F.lit(seconds), now),
        "attempt_count": F.col("attempt_count") + 1, "started_at": F.coalesce("started_at", now),
    }
    return out.withColumns({k: F.when(on, v).otherwise(F.col(k)) for k, v in changed.items()}).drop("_take")


def failed(jobs: DataFrame, now: Column, error: Column) -> DataFrame:
    """Jobs after a failure: dead where attempts are used up, else due again after the backoff."""
    dead = F.col("attempt_count") >= F.col("max_attempts")
    return jobs.withColumns({
        "status": F.when(dead, "dead_letter").otherwise("failed"), "error_message": F.substring(error, 1, ERROR_CHARS), "leased_by": F.lit(None).cast("string"),
        "lease_expires_at": F.lit(None).cast("timestamp"), "finished_at": F.when(dead, now),
        "available_at": F.when(dead, F.col("available_at")).otherwise(F.timestamp_add("SECOND", backoff_seconds(F.col("attempt_count")), now)),
    })


def finished(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.withColumns({"status": F.lit("succeeded"), "finished_at": now, "leased_by": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp")})


def retry_as_new(jobs: DataFrame, tag: Column) -> DataFrame:
    """Fresh pending copies; the originals stay. tag makes the new key unique for each retry."""
    key = F.concat_ws(":", F.lit("retry"), F.col("job_id").cast("string"), tag.cast("string"))
    return jobs.withColumns({"error_details": F.to_json(F.struct(F.col("job_id").cast("string").alias("retry_of"))), "idempotency_key": key, "status": F.lit("pending"), "attempt_count": F.lit(0), "job_id": F.sha2(key, 256)})


def workers(beats: DataFrame, now: Column, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """The latest heartbeat of each worker, stale where it is older than the limit, with its counters.

    beats: worker_id, ts, state, ok (long), bad (long).
    """
    latest = beats.groupBy("worker_id").agg(F.max("ts").alias("last_seen_at"), F.max_by("state", F.struct("ts", "beat_id")).alias("state"), F.sum("ok").alias("processed_count"), F.sum("bad").alias("failed_count"))
    age = F.unix_micros(now) - F.unix_micros("last_seen_at")
    return latest.withColumn("state", F.when(age > stale_seconds * 1_000_000, "stale").otherwise(F.col("state")))


def work(jobs: DataFrame, worker: str, now: Column, process: Callable[[DataFrame], DataFrame], seconds: int = 60, limit: int = 1) -> tuple[DataFrame, DataFrame]:
    """(all jobs, this turn's) after one turn of the work loop: the next `limit` jobs are leased and processed as a batch.

    process gets the leased jobs and returns (job_id, error), error null where a job went well; a job that it doesn't return
    has failed too. The caller writes the result as the queue's next snapshot.
    """
    leased = lease(jobs, worker, now, seconds, limit)
    mine = lease_candidates(jobs, now, limit).select("job_id").join(leased, "job_id")
    told = process(mine).select("job_id", "error", F.lit(True).alias("_told"))
    rows = mine.join(told, "job_id", "left").withColumn("error", F.when(F.col("_told").isNull(), "not processed").otherwise(F.col("error")))
    good, bad = rows.where("error IS NULL"), rows.where("error IS NOT NULL")
    done = finished(good.drop("error", "_told"), now).unionByName(failed(bad, now, F.col("error")).drop("error", "_told"), allowMissingColumns=True)
    return jobs.join(done.select("job_id"), "job_id", "left_anti").unionByName(done, allowMissingColumns=True), done
