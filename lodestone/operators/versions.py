"""Append-only versions with a current pointer, snapshot diffs, metadata and restore checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(observations: DataFrame, key: str, hash_: str, order: list[str]) -> DataFrame:
    """Versions from observations: the first of each content is one; seeing an older content again
    moves the pointer back without a new version. order ends with a unique column, the version's id."""
    unique = order[-1]
    by_key = Window.partitionBy(key).orderBy(*order)
    same = Window.partitionBy(key, hash_).orderBy(*order)
    rows = observations.withColumn("version_id", F.first(unique).over(same))
    rows = rows.withColumn("previous_version_id", F.lag("version_id").over(by_key))
    made = rows.where(F.col(unique) == F.col("version_id"))
    return made.withColumn("change_type", F.when(F.col("previous_version_id").isNull(), "created").otherwise("modified"))


def current(observations: DataFrame, key: str, hash_: str, order: list[str]) -> DataFrame:
    """(key, current hash): what each pointer shows after all observations; a pre-aggregated maximum, no window."""
    return observations.groupBy(key).agg(F.max_by(hash_, F.struct(*order)).alias("current_hash"))


def diff(scan: DataFrame, catalog: DataFrame) -> DataFrame:
    """What a scan changes: created, modified, restored, unchanged, deleted or none.

    scan: path, content_hash. catalog: path, current_hash, state. One full outer join; expensive work
    (chunking, embedding) is then due only for created, modified and restored rows.
    """
    both = scan.join(catalog, "path", "full_outer")
    gone, new = F.col("content_hash").isNull(), F.col("current_hash").isNull()
    kind = (
        F.when(gone & (F.col("state") == "deleted"), "none").when(gone, "deleted").when(new, "created").when(F.col("state") == "deleted", "restored")
        .when(F.col("content_hash") == F.col("current_hash"), "unchanged").otherwise("modified")
    )
    return both.withColumn("change_type", kind)


def metadata(parsed: Column, overlay: dict[str, Column]) -> Column:
    """Parsed metadata under the pipeline's own keys, which win."""
    own = F.create_map(*[x for k, v in overlay.items() for x in (F.lit(k), v)])
    return F.map_concat(F.map_filter(parsed, lambda k, _: ~k.isin(list(overlay))), own)


def table_sums(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table: rows, and a sum over all rows that doesn't depend on their order."""
    out = None
    for name, df in tables.items():
        total = F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")
        row = df.agg(F.count(F.lit(1)).alias("rows"), total.alias("content_sum")).select(F.lit(name).alias("table"), "rows", "content_sum")
        out = row if out is None else out.unionByName(row)
    return out


def probe_counts(tables: dict[str, DataFrame], probes: list[tuple[str, str, str]]) -> DataFrame:
    """(check, n): of each (table, column, text) how many rows hold the text, in any case of letters; kept beside a manifest."""
    out = None
    for name, column, held in probes:
        row = tables[name].agg(F.count_if(F.lower(column).contains(held.lower())).alias("n")).select(F.lit(f"holds:{name}.{column}:{held}").alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def restore_check(manifest: DataFrame, restored: dict[str, DataFrame], links: list[tuple[str, str, str, str]], probes: list[tuple[str, str, str]] = (), probed: DataFrame | None = None) -> DataFrame:
    """A row for each table's rows and content against a manifest as table_sums() or a backup gives it, for each link (child
    rows without a parent), and for each of probe_counts() against what it was (`probed`)."""
    named = manifest.select("table", "rows", "content_sum")
    names = [r["table"] for r in manifest.select("table").collect()]  # one row a table
    sums = table_sums({n: restored[n] for n in names}).select("table", F.col("rows").alias("found"), F.col("content_sum").alias("sum"))
    both = named.join(sums, "table")
    out = both.select(F.concat(F.lit("rows:"), "table").alias("check"), F.col("rows").alias("expected"), "found")
    out = out.unionByName(both.select(F.concat(F.lit("content:"), "table").alias("check"), F.lit(1).cast("long").alias("expected"), (F.col("content_sum") == F.col("sum")).cast("long").alias("found")))
    for child, ckey, parent, pkey in links:
        lost = restored[child].select(ckey).join(restored[parent].select(F.col(pkey).alias(ckey)), ckey, "left_anti").agg(F.count(F.lit(1)).alias("found"))
        out = out.unionByName(lost.select(F.lit(f"link:{child}.{ckey}").alias("check"), F.lit(0).cast("long").alias("expected"), "found"))
    if probes:
        out = out.unionByName(probed.withColumnRenamed("n", "expected").join(probe_counts(restored, list(probes)).withColumnRenamed("n", "found"), "check"))
    return out.withColumn("ok", F.col("expected") == F.col("found"))
