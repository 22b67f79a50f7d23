"""File changes as a stream: micro-batches merged by path and enqueued once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.streaming import stateful as st

#: Fixed value: how long changes are gathered.
DEBOUNCE = "750 milliseconds"
CHANGE_SCHEMA = "path string, change string, ts timestamp, size_bytes long, mtime_ns long, seen boolean"


def merge_changes(changes: DataFrame, order: list[str]) -> DataFrame:
    """The last change of each path."""
    rest = [c for c in changes.columns if c != "path"]
    return changes.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select("path", "last.*")


def classify(changes: DataFrame) -> DataFrame:
    """watch_index with the file's size and time where it exists, else watch_delete; the key of a delete has
    the time of the change, so that a later deletion is a job of its own."""
    job = F.when(F.col("seen"), "watch_index").otherwise("watch_delete")
    when = F.when(F.col("seen"), F.col("mtime_ns")).otherwise(F.unix_micros("ts"))
    size = F.when(F.col("seen"), F.col("size_bytes")).otherwise(0)
    key = F.sha2(F.concat_ws("\0", job, F.lower("path"), size.cast("string"), when.cast("string")), 256)
    return changes.withColumn("job_type", job).withColumn("idempotency_key", key)


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Changes that a watcher drops as JSON files."""
    return spark.readStream.schema(CHANGE_SCHEMA).json(folder)


def enqueue_stream(changes: DataFrame, jobs_path: str, checkpoint: str, available_now: bool = False, ttl_ms: int = st.REMEMBERED_MS) -> StreamingQuery:
    """Appends new jobs to a table of files, each key once; what was seen is the stream's state, not a read of the table."""
    jobs = st.once(classify(changes), ttl_ms)
    writer = jobs.writeStream.format("parquet").option("path", jobs_path).option("checkpointLocation", checkpoint).outputMode("append")
    if not available_now:
        return writer.trigger(processingTime=DEBOUNCE).start()
    return st.start_once(writer)
