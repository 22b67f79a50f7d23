"""File roots, scans and snapshots."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths as px
from lodestone.operators import versions as vs


def load_roots(path: str) -> list[dict]:
    """The `source_roots` list of a JSON or (simple) YAML file; empty if there is none."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(raw or "{}").get("source_roots") or []
    import yaml

    return (yaml.safe_load(raw) or {}).get("source_roots") or []


def register_roots(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known roots, unchanged, and those of `new` whose path isn't known."""
    fresh = new.dropDuplicates(["canonical_path"]).join(known.select("canonical_path"), "canonical_path", "left_anti")
    return known.unionByName(fresh, allowMissingColumns=True)


def scan_stats(found: DataFrame, known_keys: DataFrame | None = None) -> DataFrame:
    """ScanStats as one row; a file whose key is known is visited and nothing else."""
    if known_keys is not None:
        known = known_keys.select("idempotency_key", F.lit(True).alias("_known")).dropDuplicates(["idempotency_key"])
        found = found.join(known, "idempotency_key", "left").withColumn("outcome", F.when(F.col("_known"), "known").otherwise(F.col("outcome")))
    count = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return found.agg(F.count_if(F.col("outcome") != "ignored_directory").alias("visited"), count("queued").alias("queued"), count("ignored", "ignored_directory").alias("ignored"), count("unsupported").alias("unsupported"), count("error").alias("errors"))


def outcome_column(path, size, extra: list[str] | None = None, include: list[str] | None = None, max_bytes: int = px.MAX_FILE_BYTES):
    """A file's outcome: ignored (by a rule, or because no include pattern has it), unsupported, oversize (ignored), else queued."""
    left_out = px.ignored(path, extra)
    if include:
        left_out = left_out | ~path.rlike("|".join(px.glob_regex(p) for p in include))
    return F.when(left_out, "ignored").when(~px.suffix(path).isin(px.SUPPORTED), "unsupported").when(size > max_bytes, "ignored").otherwise("queued")


def knowledge_ignores(spark: SparkSession, root: str) -> list[str]:
    """The patterns of the root's `.knowledgeignore`, without blank lines and comments; none if there is no such file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.knowledgeignore")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    lines = [r["value"] for r in spark.read.text(path.toString()).collect()]  # one small file of patterns
    return [x.rstrip() for x in lines if x.strip() and not x.lstrip().startswith("#")]


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, include: list[str] | None = None, max_bytes: int = px.MAX_FILE_BYTES) -> DataFrame:
    """(path, size, modified, content, outcome, problem) of a root on any file system Spark reads.

    Ignored are the defaults, the root's `.knowledgeignore` and `exclude`. content is null and isn't read into the
    checks unless a file is queued: its length and suffix decide first. Object stores have no links; on a local file
    system sources.tree leaves links out, and doesn't read what isn't queued.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z0-9]+:(//[^/]*)?/+", "/", root).rstrip("/") + "/"  # neither side keeps scheme or host
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?/+", "/"), f"^{re.escape(base)}", "")
    extra = [*knowledge_ignores(spark, root), *(exclude or [])]
    rows = files.withColumn("outcome", outcome_column(rel, F.col("length"), extra, include, max_bytes))
    rows = rows.select(rel.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.when(F.col("outcome") == "queued", F.col("content")).alias("content"), "outcome")
    binary = F.contains(F.substring("content", 1, px.BINARY_PROBE), F.lit(b"\x00"))
    problem = F.when(F.col("size_bytes") > max_bytes, "too large").when(binary, "binary").when(~F.is_valid_utf8("content"), "not UTF-8")
    return rows.withColumn("problem", problem)


def read_texts(scanned: DataFrame) -> DataFrame:
    """Decoded texts of queued files without a problem, with their hashes."""
    good = scanned.where((F.col("outcome") == "queued") & F.col("problem").isNull())
    return good.select("path", "size_bytes", "modified_at", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("content_hash"))


def backup(tables: dict[str, DataFrame], folder: str, about: dict[str, str] | None = None) -> DataFrame:
    """Parquet snapshots that refuse to overwrite, and a manifest of rows and an order-free content sum.

    about: what the manifest says besides, such as a hash of the configuration; the time and Spark's version are added.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    sums = vs.table_sums({n: spark.read.parquet(f"{folder}/{n}") for n in tables})
    notes = {**(about or {}), "spark_version": spark.version}
    out = sums.withColumn("made_at", F.current_timestamp()).withColumn("about", F.create_map(*[F.lit(x) for kv in notes.items() for x in kv]))
    out.coalesce(1).write.mode("errorifexists").json(f"{folder}/_manifest")  # a row a table
    return spark.read.schema(out.schema).json(f"{folder}/_manifest")
