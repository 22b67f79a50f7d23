"""The write path and lookups over the standard tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import store as st

from .search_queries import read

NOW = "2024-02-01 00:00:00"
ROOT = "root"


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files of one root, below their source."""
    d = read(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.lit(ROOT).alias("root_id"), path.alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit(NOW).cast("timestamp").alias("modified_at"), F.sha2("text", 256).alias("content_hash"), "text", "doc_id")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are known already: those of good quality with the text they have, toxic ones as deleted."""
    marks = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    rows = scanned(spark, sf_dir).join(marks, "doc_id")
    known = F.sha2(F.when(F.col("q") == 1, F.col("text")).otherwise(F.lit("older")), 256)
    rows = rows.withColumn("content_hash", known).withColumn("document_id", st.id_of(F.col("root_id"), F.col("path")))
    none = F.lit(None)
    return rows.select(
        "document_id", "root_id", "path", *[none.cast("string").alias(c) for c in ("filename", "suffix", "mime_type", "project", "parent_path")], F.lit(0).cast("long").alias("size_bytes"),
        F.lit(NOW).cast("timestamp").alias("modified_at"), "content_hash", st.id_of(F.col("document_id"), F.col("content_hash")).alias("version_id"),
        F.when(F.col("t") == 1, "deleted").otherwise("active").alias("state"), F.lit("2023-01-01").cast("timestamp").alias("first_seen_at"), F.lit("2023-01-01").cast("timestamp").alias("last_seen_at"),
    )


def _now():
    return F.lit(NOW).cast("timestamp")


def _merged(spark, sf_dir):
    return st.upsert_documents(catalog(spark, sf_dir), scanned(spark, sf_dir).drop("doc_id"), F.lit(ROOT), _now())


_MERGED = f"""k AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1),
d AS (SELECT doc_id, text, source, source || '/doc' || doc_id || '.txt' AS path, sha256(text) AS h FROM documents),
c AS (SELECT doc_id, sha256(CASE WHEN q = 1 THEN text ELSE 'older' END) AS old, CASE WHEN t = 1 THEN 'deleted' ELSE 'active' END AS state FROM d JOIN k USING (doc_id)),
i AS (SELECT d.*, old, state, sha256('{ROOT}' || chr(0) || path) AS document_id,
 CASE WHEN old IS NULL THEN 'created' WHEN state = 'deleted' THEN 'restored' WHEN old = h THEN 'unchanged' ELSE 'modified' END AS change_type FROM d LEFT JOIN c USING (doc_id)),
m AS (SELECT *, sha256(document_id || chr(0) || h) AS version_id, sha256(document_id || chr(0) || old) AS previous_version_id FROM i)"""


def document_upsert(spark, sf_dir):
    return _merged(spark, sf_dir).select("path", "document_id", "filename", "project", "size_bytes", "content_hash", "version_id", "previous_version_id", "state", "change_type")


UPSERT_SQL = f"WITH {_MERGED} SELECT path, document_id, 'doc' || doc_id || '.txt' AS filename, source AS project, strlen(text)::BIGINT AS size_bytes, h AS content_hash, version_id, previous_version_id, 'active' AS state, change_type FROM m"


def _versions(spark, sf_dir):
    known = catalog(spark, sf_dir).select("version_id")
    return st.new_versions(_merged(spark, sf_dir), scanned(spark, sf_dir), known, _now(), {"pipeline_version": F.lit("p1")})


def version_append(spark, sf_dir):
    return _versions(spark, sf_dir).select("version_id", "document_id", "byte_size", F.col("line_count").cast("long").alias("line_count"), "previous_version_id", "previous_hash", "change_type", F.col("metadata")["pipeline_version"].alias("pipeline_version"))


_LINES = "CASE WHEN text = '' THEN 0 WHEN text LIKE '%' || chr(10) THEN len(string_split(text, chr(10))) - 1 ELSE len(string_split(text, chr(10))) END"
VERSIONS_SQL = f"""WITH {_MERGED} SELECT version_id, document_id, strlen(text)::BIGINT AS byte_size, CAST({_LINES} AS BIGINT) AS line_count, previous_version_id, old AS previous_hash, change_type, 'p1' AS pipeline_version
FROM m WHERE old IS NULL OR old <> h"""


def chunk_append(spark, sf_dir):
    c = st.new_chunks(_versions(spark, sf_dir).persist())  # the kinds of chunks each read it
    return c.select("chunk_id", "version_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_type", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content_hash", F.col("token_estimate").cast("long").alias("token_estimate"))


_CHUNKS = f"""l AS (SELECT version_id, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS l FROM m WHERE old IS NULL OR old <> h),
s AS (SELECT version_id, l, unnest(range(0, len(l), 100)) AS s FROM l), x AS (SELECT version_id, s // 100 AS chunk_index, s, len(l) AS n, array_to_string(l[s + 1 : s + 100], chr(10)) AS content FROM s)"""
CHUNKS_SQL = f"""WITH {_MERGED}, {_CHUNKS} SELECT sha256(version_id || chr(0) || chunk_index) AS chunk_id, version_id, chunk_index, 'line_window' AS chunk_type, s + 1 AS start_line, least(s + 100, n) AS end_line,
 sha256(content) AS content_hash, greatest(1, length(content) // 4) AS token_estimate FROM x"""


def ingest_events(spark, sf_dir):
    v = _versions(spark, sf_dir).persist()
    e = st.ingest_events(v, st.new_chunks(v), _now())
    return e.select("document_id", "event_type", "path", F.col("details")["version_id"].alias("version_id"), F.col("details")["chunks"].alias("chunks"))


EVENTS_SQL = f"WITH {_MERGED}, {_CHUNKS} SELECT document_id, 'indexed' AS event_type, path, version_id, CAST((SELECT count(*) FROM x WHERE x.version_id = m.version_id) AS VARCHAR) AS chunks FROM m WHERE old IS NULL OR old <> h"


def document_deletions(spark, sf_dir):
    """Known documents of toxic label go; the rest of the catalog stays."""
    gone = read(spark, sf_dir, "labels").where("toxic = 1").join(scanned(spark, sf_dir), "doc_id").select("root_id", "path")
    return st.mark_deleted(catalog(spark, sf_dir), gone, _now()).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min(F.date_format("last_seen_at", "yyyy")).alias("seen"))


DELETIONS_SQL = f"WITH {_MERGED} SELECT state, count(*) AS n, CASE WHEN state = 'deleted' THEN '2024' ELSE '2023' END AS seen FROM m WHERE old IS NOT NULL GROUP BY 1, 3"

_ONE = "SELECT min(source || '/doc' || doc_id || '.txt') FROM documents"


def _one(spark, sf_dir) -> str:
    """The id of the first document by path: one value."""
    return scanned(spark, sf_dir).agg(F.min("path").alias("p")).select(st.id_of(F.lit(ROOT), F.col("p")).alias("d")).first()["d"] or ""


def document_detail(spark, sf_dir):
    one = _one(spark, sf_dir)
    asked = scanned(spark, sf_dir).where(st.id_of(F.lit(ROOT), F.col("path")) == one)  # only this document is cut into chunks
    whole = st.upsert_documents(catalog(spark, sf_dir).limit(0), asked.drop("doc_id"), F.lit(ROOT), _now())
    chunks = st.new_chunks(whole.join(asked.select("path", "text"), "path").persist())
    found = st.document_detail(whole.select("document_id", "version_id", "filename", "state"), chunks, one)
    return found.select("document_id", "filename", "state", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_type", F.col("start_line").cast("long").alias("start_line"), F.sha2("content", 256).alias("content_hash"))


DETAIL_SQL = f"""WITH m AS (SELECT doc_id, text, path, sha256('{ROOT}' || chr(0) || path) AS document_id, 'v' AS version_id, NULL AS old, '' AS h FROM (SELECT *, source || '/doc' || doc_id || '.txt' AS path FROM documents) WHERE path = ({_ONE})),
{_CHUNKS} SELECT document_id, 'doc' || doc_id || '.txt' AS filename, 'active' AS state, chunk_index, 'line_window' AS chunk_type, s + 1 AS start_line, sha256(content) AS content_hash FROM m, x"""


def document_versions(spark, sf_dir):
    """The versions of the user who has the first event, latest first."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("version_id"), F.col("ts").cast("timestamp").alias("detected_at"), F.col("event_type").alias("content_hash"))
    first = e.agg(F.min_by("document_id", "version_id").alias("d")).first()["d"]
    return st.versions_of(e, first or "").select("version_id", "content_hash")


VERSIONS_OF_SQL = "SELECT event_id AS version_id, event_type AS content_hash FROM events WHERE user_id = (SELECT arg_min(user_id, event_id) FROM events)"


def backlink_lookup(spark, sf_dir):
    """Pages that link to the first target by name, with the link's place among the page's."""
    links = read(spark, sf_dir, "pages").select(F.col("page_id").alias("source_document_id"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("source_line", "target_document_id")).withColumn("link_type", F.lit("href"))
    first = links.agg(F.min("target_document_id").alias("t")).first()["t"]
    return st.backlinks_of(links, first or "").select("source_document_id", F.col("line").cast("long").alias("line"), "type")


BACKLINK_SQL = """WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS line FROM pages)
SELECT page_id AS source_document_id, line, 'href' AS type FROM e WHERE t = (SELECT min(t) FROM e)"""


def document_listing(spark, sf_dir):
    """Documents as a listing shows them, with display prefixes."""
    d = _merged(spark, sf_dir).withColumn("canonical_path", F.concat(F.lit("/root/"), "path"))
    p = st.projected(d, st.DOCUMENT_ROW)
    return p.select("id", "relative_path", "canonical_path", "filename", "project", "state", "size_bytes", "modified_at", st.status_class(F.col("state")).alias("status_class"), st.shown("current_version_id").alias("version_shown"), st.shown("content_hash").alias("hash_shown"))


LISTING_SQL = f"""WITH {_MERGED} SELECT document_id AS id, path AS relative_path, '/root/' || path AS canonical_path, 'doc' || doc_id || '.txt' AS filename, source AS project, 'active' AS state, strlen(text)::BIGINT AS size_bytes,
 '2024-02-01T00:00:00.000000+00:00' AS modified_at, 'good' AS status_class, substring(version_id, 1, 8) AS version_shown, substring(h, 1, 12) AS hash_shown FROM m"""


def event_json(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("path"), F.col("props").alias("details"), st.from_epoch(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("created_at"))
    return st.as_json(st.projected(e, st.EVENT_ROW))


EVENT_SQL = """SELECT '{"id":' || event_id || ',"event":"' || event_type || '","path":"' || user_id || '","details":"' || replace(props, '"', chr(92) || '"') || '","created_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00"}' AS json FROM events"""


def readiness(spark, sf_dir):
    return st.readiness({n: read(spark, sf_dir, n) for n in ("documents", "embeddings", "events")})


READY_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) > 0 AS ready FROM {n}" for n in ("documents", "embeddings", "events"))

QUERIES = {f.__name__: f for f in (document_upsert, version_append, chunk_append, ingest_events, document_deletions, document_detail, document_versions, backlink_lookup, document_listing, event_json, readiness)}
ORACLE_SQL = {
    "document_upsert": UPSERT_SQL, "version_append": VERSIONS_SQL, "chunk_append": CHUNKS_SQL, "ingest_events": EVENTS_SQL, "document_deletions": DELETIONS_SQL, "document_detail": DETAIL_SQL,
    "document_versions": VERSIONS_OF_SQL, "backlink_lookup": BACKLINK_SQL, "document_listing": LISTING_SQL, "event_json": EVENT_SQL, "readiness": READY_SQL,
}
