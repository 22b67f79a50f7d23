"""Operator 6: mixing sources to target weights along a time-varying curriculum.

Each source's target comes from its weight; a target stops at MAX_REPEATS times the source's size and
the excess is reshared by weight until none is above (water filling). A source is read floor(target
/ size) times in full and once in part, in an order fixed by a hash of the row; a partial pass takes
a row whole or not at all, so a source misses its target by at most half a row.

The curriculum: a source's weight at time t in [0, 1] goes from `start` to `end` in a straight line.
Its integral is the source's cumulative demand; inverting it at a row's place in the source's stream
gives the time at which the row is due, and the demands of all sources at that time give its
position in the mix, in words. Rows are then range-sorted by position.

Running places within a source are two-level sums, so a source with a third of all rows is spread
over many tasks. All arithmetic that decides what is taken is on integers and fixed hashes: reruns
agree. What is collected is one row for each source, of at most MAX_SOURCES. A source's rows are dealt into
buckets by a hash of id and text, the more the larger the table; only rows equal in both share one for sure.

Rows: null text has size 0 and is never taken for words; a null source is a source of its own, last
in order. Very long texts are rows like any other. Repeated rows are rows of their own. Null doc_ids are allowed. An empty table gives an
empty table. Input columns with added names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, materialize, texts

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Least number of buckets of a source's rows, and rows of all sources that call for one more.
BUCKETS = 512
BUCKET_ROWS = 50_000
#: Sources are planned on the driver, a row each: more are refused.
MAX_SOURCES = 100_000
#: Relative weight at the start and the end of training, for the first, second and third source and so on.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
ADDED = ["size", "source_size", "target", "copies", "taken", "positions"]


def targets(sizes: list[int], weights: list[float], most: float = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight, none above `most` times its size."""
    out, free, budget = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if budget * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = budget * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            budget -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def _source_plan(sized: DataFrame) -> tuple[DataFrame, int]:
    """(one row for each source: its size, target, full passes and curriculum; how many buckets)."""
    spark = sized.sparkSession
    sums = sized.groupBy("_src").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found, buckets = sorted((r["_src"], int(r["s"])) for r in sums), max(BUCKETS, sum(r["c"] for r in sums) // BUCKET_ROWS)
    sizes = [s for _, s in found]
    goal = targets(sizes, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(found))])
    a_sum = b_sum = 0.0  # demand of all sources together by time t: a_sum t + b_sum t^2
    rows = []
    for i, (src, size) in enumerate(found):
        start, end = SCHEDULES[i % len(SCHEDULES)]
        a, b = 2 * start / (start + end), (end - start) / (start + end)
        a_sum, b_sum = a_sum + goal[i] * a, b_sum + goal[i] * b
        full = int(goal[i] // size) if size else 0
        rows.append((src, size, goal[i], full, goal[i] - full * size if size else 0.0, a, b))
    schema = "_src string, source_size long, target double, _full long, _rest double, _a double, _b double"
    return spark.createDataFrame(rows, schema).withColumn("_asum", F.lit(a_sum)).withColumn("_bsum", F.lit(b_sum)), buckets


def mix(df: DataFrame, text: str = "text", source: str = "source", order: str = "doc_id") -> DataFrame:
    """Every row of df with ADDED: how many copies the mix takes of it and where each stands."""
    sized = df.drop(*[c for c in ADDED if c in df.columns]).withColumn("size", word_count(F.col(text)))
    return mix_sized(sized, source, order, F.xxhash64(F.col(text)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mix_sized(df: DataFrame, source: str = "source", order: str = "doc_id", tie: Column | None = None) -> DataFrame:
    """mix() of rows that have their size already. tie: tells apart rows that agree in `order`."""
    names = [c for c in df.columns if c not in ADDED]
    tie = F.lit(0) if tie is None else tie
    sized = df.withColumn("_src", F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))))
    plan, buckets = _source_plan(sized.select("_src", "size"))
    sized = sized.withColumn("_h", F.xxhash64(F.lit(6), F.col(order), tie)).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    totals = sized.groupBy("_src", "_bucket").agg(F.sum("size").alias("_total"))
    base = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # sources x buckets rows with the source's plan beside them; small, but not broadcast by force
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(base), F.lit(0))).join(plan, "_src").drop("_total")
    inside = Window.partitionBy("_src", "_bucket").orderBy("_h", order, tie, "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["_src", "_bucket"])
    rows = rows.withColumn("_before", F.col("_base") + F.col("_in"))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("_full") + (F.col("_before") + F.col("size") / 2 <= F.col("_rest")).cast("long")).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("taken", F.col("copies") * F.col("size"))

    def position(k):
        u = F.least(F.lit(1.0), (k * F.col("source_size") + F.col("_before") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1e-9)))
        t = 2 * u / (F.col("_a") + F.sqrt(F.greatest(F.lit(0.0), F.col("_a") * F.col("_a") + 4 * F.col("_b") * u)))
        return F.col("_asum") * t + F.col("_bsum") * t * t

    passes = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast(T.ArrayType(T.LongType())))
    rows = rows.withColumn("positions", F.transform(passes, position))
    return rows.select(*[F.col(f"`{c}`") for c in names], *ADDED)


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy, range-sorted by position; the partitions in their order are the training order."""
    out = mixed.withColumn("position", F.explode("positions"))
    return out.repartitionByRange("position").sortWithinPartitions("position")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ids and sizes only travel; rows come out in the order in which the mix first meets them
    docs = texts(spark, sf_dir, "doc_id", "source", "text")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")  # words are counted once
    mixed = mix_sized(sized, tie=F.col("tie")).withColumn("position", F.get("positions", F.lit(0)))
    ordered = mixed.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
