"""Fixed reports: counts, listings, timeline, metrics and their text export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped_count(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of each key, most first; null is a group."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc_nulls_first(key))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page; offset plus limit is a top-k, not a full sort."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("page from 1, size from 1 to 200")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def tree(df: DataFrame, group: str, item: str, limit: int = 2000, children: int = 250, project: str | None = None) -> DataFrame:
    """The first `limit` items by name under their groups, with the flag that says the limit was met.

    project: only this group.
    """
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be between 1 and 5000")
    if project is not None:
        df = df.where(F.col(group) == project)
    first = df.select(group, item).orderBy(item, group).limit(limit)
    total = first.agg((F.count(F.lit(1)) == limit).alias("truncated"))
    grouped = first.groupBy(group).agg(F.slice(F.array_sort(F.collect_list(item)), 1, children).alias("items"))
    return grouped.crossJoin(total)  # one row


def timeline(events: DataFrame, limit: int = 100) -> DataFrame:
    """The latest events, ties by id. events: ts, event_id."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def oldest_age_seconds(jobs: DataFrame, now: Column) -> DataFrame:
    age = (F.unix_micros(now) - F.unix_micros(F.min("created_at"))) / 1_000_000
    return jobs.where(F.col("status") == "pending").agg(F.coalesce(age, F.lit(0.0)).alias("oldest_pending_seconds"))


def exposition(metrics: DataFrame, prefix: str) -> DataFrame:
    """One row with a text of `# TYPE` and value lines. metrics: ord, name, label, value (few rows)."""
    name = F.concat(F.lit(prefix + "_"), "name")
    labelled = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit('{status="'), "label", F.lit('"}')))
    line = F.concat(F.when(F.col("label").isNull(), F.concat(F.lit("# TYPE "), name, F.lit(" gauge\n"))).otherwise(F.lit("")), name, labelled, F.lit(" "), F.col("value").cast("string"))
    rows = metrics.select(F.struct("ord", F.coalesce("label", F.lit("")).alias("k"), line.alias("line")).alias("r"))
    lines = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"])
    return rows.agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("exposition"))
