"""The write path as column work: documents are merged with a scan; versions, chunks, vectors and events are appended.

Ids are hashes of what they name, so a repeated or restarted run makes the same rows, and a document that goes back
to an older content points to the older version again. Tables are append-only folders of batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import metadata as md
from lodestone.functions import paths as px
from lodestone.functions import text as tx
from lodestone.operators import chunking as ch

DOCUMENT = ["document_id", "root_id", "path", "filename", "suffix", "mime_type", "project", "parent_path", "size_bytes", "modified_at", "content_hash", "version_id", "state", "first_seen_at", "last_seen_at"]


def id_of(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def upsert_documents(catalog: DataFrame, texts: DataFrame, root_name: Column, now: Column) -> DataFrame:
    """The catalog after a scan, with change_type: created, modified, restored, unchanged or untouched.

    catalog: DOCUMENT. texts: root_id, path, size_bytes, modified_at, content_hash. One full outer join by root and path; rows
    that the scan doesn't have stay as they are (deletions are changes of their own: mark_deleted).
    """
    seen = texts.select("root_id", "path", *[F.col(c).alias(f"_{c}") for c in ("size_bytes", "modified_at", "content_hash")])
    both = catalog.join(seen, ["root_id", "path"], "full_outer")
    new, here = F.col("document_id").isNull(), F.col("_content_hash").isNotNull()
    kind = (
        F.when(~here, "untouched").when(new, "created").when(F.col("state") == "deleted", "restored")
        .when(F.col("content_hash") == F.col("_content_hash"), "unchanged").otherwise("modified")
    )
    path = F.col("path")
    made = {"filename": px.filename(path), "suffix": px.suffix(path), "mime_type": px.mime_type(path), "project": px.project_key(path, root_name), "parent_path": px.parent(path)}
    document = F.coalesce("document_id", id_of(F.col("root_id"), path))
    columns = {
        "document_id": document, **{k: F.coalesce(F.col(k), v) for k, v in made.items()},
        **{k: F.coalesce(F.col(f"_{k}"), F.col(k)) for k in ("size_bytes", "modified_at")},
        "previous_hash": F.col("content_hash"), "previous_version_id": F.col("version_id"),
        "content_hash": F.coalesce("_content_hash", "content_hash"), "version_id": F.when(here, id_of(document, F.col("_content_hash"))).otherwise(F.col("version_id")),
        "state": F.when(here, "active").otherwise(F.col("state")), "first_seen_at": F.coalesce("first_seen_at", now), "last_seen_at": F.when(here, now).otherwise(F.col("last_seen_at")), "change_type": kind,
    }
    rest = [c for c in DOCUMENT if c not in columns]
    return both.select(*rest, *[v.alias(k) for k, v in columns.items()])


def mark_deleted(catalog: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """The catalog with the paths of `gone` (root_id, path) deleted; their versions stay."""
    lost = gone.select("root_id", "path", F.lit(True).alias("_gone")).dropDuplicates(["root_id", "path"])
    out = catalog.join(lost, ["root_id", "path"], "left")
    hit = F.coalesce("_gone", F.lit(False))
    return out.withColumn("state", F.when(hit, "deleted").otherwise(F.col("state"))).withColumn("last_seen_at", F.when(hit, now).otherwise(F.col("last_seen_at"))).drop("_gone")


def new_versions(merged: DataFrame, texts: DataFrame, versions: DataFrame, now: Column, own: dict[str, Column] | None = None, nested: bool = False) -> DataFrame:
    """Versions to append, with their text: contents that a document has not had before.

    merged: upsert_documents(). own: the pipeline's metadata keys, which win over the text's front matter. nested: metadata
    is a VARIANT with all that the front matter nests, and own keys are paths (`a.b`); else a map of strings.
    """
    due = merged.where(F.col("change_type").isin("created", "modified", "restored")).where(~F.col("content_hash").eqNullSafe(F.col("previous_hash")))
    due = due.join(versions.select("version_id"), "version_id", "left_anti").join(texts.select("root_id", "path", "text"), ["root_id", "path"])
    is_md = F.col("suffix").isin(px.MARKDOWN)
    known = F.when(is_md, (md if nested else ch).frontmatter(F.col("text"))).otherwise(F.parse_json(F.lit("{}")) if nested else F.create_map().cast("map<string,string>"))
    if own and nested:
        known = md.overlay(known, own)
    elif own:
        keys = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])
        known = F.map_concat(F.map_filter(known, lambda k, _: ~k.isin(list(own))), keys)
    return due.select(
        "version_id", "document_id", "path", "content_hash", F.col("size_bytes").alias("byte_size"), F.col("modified_at").alias("modified_at_fs"), now.alias("detected_at"),
        F.size(tx.lines(F.col("text"))).alias("line_count"), known.alias("metadata"), "previous_version_id", "change_type", "previous_hash", "text",
    )


def new_chunks(versions: DataFrame) -> DataFrame:
    """Chunks to append for new_versions(), each under the hash of its version and place."""
    cut = ch.chunk_documents(versions.select("version_id", "path", "text"), "version_id")
    return cut.withColumn("chunk_id", id_of(F.col("version_id"), F.col("chunk_index")))


def new_embeddings(chunks: DataFrame, vector: Column, dimension: int, revision: str, provider: str, model: str, digest: str) -> DataFrame:
    """A vector for each chunk, none left out; a wrong size stops the job."""
    sized = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding dimension mismatch")))
    out = chunks.select("chunk_id", vector.alias("embedding"))
    return out.select(
        "chunk_id", F.lit(revision).alias("embedding_revision"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(digest).alias("model_digest"),
        F.lit(dimension).alias("dimension"), sized.alias("embedding"),
    )


def ingest_events(versions: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """An event for each new version, with how many chunks it has."""
    counts = chunks.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"))
    details = F.create_map(F.lit("version_id"), F.col("version_id"), F.lit("chunks"), F.coalesce("n", F.lit(0)).cast("string"))
    return versions.join(counts, "version_id", "left").select("document_id", F.lit("indexed").alias("event_type"), "path", details.alias("details"), now.alias("created_at"))


def deletion_events(before: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """An event for each document of the catalog that `gone` (root_id, path) takes out and that was there."""
    lost = gone.select("root_id", "path").distinct()
    return before.where("state <> 'deleted'").join(lost, ["root_id", "path"], "left_semi").select("document_id", F.lit("deleted").alias("event_type"), "path", F.lit(None).cast("map<string,string>").alias("details"), now.alias("created_at"))


def retry_events(jobs: DataFrame, retried: DataFrame, now: Column) -> DataFrame:
    """An event for each job of jobs.retry_as_new(), naming both. retried: its result."""
    told = F.create_map(F.lit("original_job_id"), F.get_json_object("error_details", "$.retry_of"), F.lit("new_job_id"), F.col("job_id").cast("string"))
    known = jobs.select(F.col("job_id").cast("string").alias("of"))
    rows = retried.join(known, F.get_json_object("error_details", "$.retry_of") == F.col("of"), "left_semi")
    return rows.select(F.lit(None).cast("string").alias("document_id"), F.lit("job_retry").alias("event_type"), F.lit(None).cast("string").alias("path"), told.alias("details"), now.alias("created_at"))


def append(df: DataFrame, folder: str, batch: int) -> None:
    """Writes a batch to a folder of its own, so that a repeated one changes nothing."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("batch")


# --- lookups --------------------------------------------------------------------------------------

def document_detail(documents: DataFrame, chunks: DataFrame, document_id: str) -> DataFrame:
    """A document with the chunks of its current version in order, a row each; one row without chunks where it has none."""
    one = documents.where(F.col("document_id") == document_id)
    return one.join(chunks, "version_id", "left").orderBy("chunk_index")


def versions_of(versions: DataFrame, document_id: str) -> DataFrame:
    """A document's versions, latest first."""
    return versions.where(F.col("document_id") == document_id).orderBy(F.desc("detected_at"), F.desc("version_id"))


def backlinks_of(links: DataFrame, target: str) -> DataFrame:
    """What links to a document. links: source_document_id, target_document_id, source_line, link_type."""
    return links.where(F.col("target_document_id") == target).select("source_document_id", F.col("source_line").alias("line"), F.col("link_type").alias("type"))


#: States shown as good (fixed values); pending ones wait, all others are dangers.
GOOD = ["healthy", "succeeded", "active", "idle", "processing"]


def status_class(status: Column) -> Column:
    return F.when(status.isin(GOOD), "good").when(status == "pending", "waiting").otherwise("danger")


def shown(column: str) -> Column:
    """What a listing shows of an id (8 characters) or a hash (12)."""
    return F.substring(column, 1, 12 if column.endswith("hash") else 8)


def iso(ts: Column) -> Column:
    """A timestamp in ISO 8601, UTC."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def from_epoch(seconds: Column) -> Column:
    """A timestamp of seconds since 1970, with fractions."""
    return F.timestamp_micros((seconds * 1_000_000).cast("long"))


#: Fields of a listing's rows: name shown, column.
DOCUMENT_ROW = [("id", "document_id"), ("source_root_id", "root_id"), ("canonical_path", "canonical_path"), ("relative_path", "path"), ("filename", "filename"), ("project", "project"), ("state", "state"), ("size_bytes", "size_bytes"), ("modified_at", "modified_at"), ("content_hash", "content_hash"), ("current_version_id", "version_id")]
VERSION_ROW = [("id", "version_id"), ("content_hash", "content_hash"), ("change_type", "change_type"), ("detected_at", "detected_at"), ("line_count", "line_count"), ("parser_version", "parser_version"), ("chunker_version", "chunker_version"), ("metadata", "metadata"), ("diff_summary", "diff_summary")]
JOB_ROW = [("id", "job_id"), ("status", "status"), ("job_type", "job_type"), ("path", "canonical_path"), ("attempt_count", "attempt_count"), ("max_attempts", "max_attempts"), ("leased_by", "leased_by"), ("error_type", "error_type"), ("error_message", "error_message"), ("created_at", "created_at"), ("finished_at", "finished_at")]
CHUNK_ROW = [("id", "chunk_id"), ("index", "chunk_index"), ("type", "chunk_type"), ("heading", "heading_path"), ("symbol", "symbol_name"), ("start_line", "start_line"), ("end_line", "end_line"), ("content", "content"), ("metadata", "metadata")]
EVENT_ROW = [("id", "event_id"), ("event", "event_type"), ("path", "path"), ("details", "details"), ("created_at", "created_at")]


def projected(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """A listing's fields in order, times in ISO 8601; a column that df lacks is null."""
    kinds = dict(df.dtypes)

    def one(name: str, column: str) -> Column:
        if column not in kinds:
            return F.lit(None).cast("string").alias(name)
        return (iso(F.col(column)) if kinds[column] == "timestamp" else F.col(column)).alias(name)

    return df.select(*[one(*f) for f in fields])


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row as an object, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def readiness(probes: dict[str, DataFrame]) -> DataFrame:
    """(name, ready) of each table: whether a first row can be read."""
    out = None
    for name, df in probes.items():
        row = df.limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), (F.col("n") > 0).alias("ready"))
        out = row if out is None else out.unionByName(row)
    return out
