"""Chunking, versions, queue, streams and reports over the standard tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths as px
from lodestone.functions import text as tx
from lodestone.operators import chunking as ch
from lodestone.operators import jobs as jb
from lodestone.operators import reports as rp
from lodestone.operators import search as se
from lodestone.operators import versions as vs
from lodestone.sources import files as fl
from lodestone.streaming import changes as cs

from .search_queries import read

NOW = "1998-09-02 00:00:00"
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.to_timestamp(F.lit(NOW))


# --- chunking ---------------------------------------------------------------------------------

_LINES = "SELECT doc_id, text, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS l FROM documents"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""WITH a AS ({_LINES}), b AS (SELECT doc_id, l, unnest(range(0, len(l), 40)) AS s FROM a)
SELECT doc_id, 'line_window' AS chunk_type, s // 40 AS chunk_index, s + 1 AS start_line, least(s + 40, len(l)) AS end_line, sha256(array_to_string(l[s + 1 : s + 40], chr(10))) AS content_hash FROM b""")
def line_windows(spark, sf_dir):
    out = ch.line_windows(read(spark, sf_dir, "documents"), "doc_id", size=40)
    return out.select("doc_id", "chunk_type", F.col("chunk_index").cast("long"), F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.sha2("content", 256).alias("content_hash"))


def markdown_of_conversations(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), "text")).alias("m"))
    grouped = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    body = F.array_join(F.transform("m", lambda m: m["col2"]), "\n")
    return grouped.select("conv_id", F.concat(F.lit("preamble\n# conv "), F.col("conv_id").cast("string"), F.lit("\n"), body).alias("text"))


@query(f"""WITH t AS (SELECT conv_id, 'preamble' || chr(10) || '# conv ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^(#{{1,6}})\\s+(.+?)\\s*$') THEN length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) END AS level, regexp_extract(line, '^(#{{1,6}})\\s+(.+?)\\s*$', 2) AS title FROM l),
s AS (SELECT *, count(level) OVER w AS section, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS t2,
 last_value(CASE WHEN level = 1 THEN n END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN level = 2 THEN n END IGNORE NULLS) OVER w AS p2 FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
g AS (SELECT conv_id, section, min(n) AS start_line, max(n) AS end_line, trim(string_agg(line, chr(10) ORDER BY n), {_BLANK}) AS content,
 CASE WHEN section > 0 THEN concat_ws(' / ', arg_min(t1, n), arg_min(CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, n)) END AS heading_path FROM s GROUP BY 1, 2)
SELECT conv_id, 'markdown_section' AS chunk_type, row_number() OVER (PARTITION BY conv_id ORDER BY section) - 1 AS chunk_index, heading_path, start_line, end_line, sha256(content) AS content_hash FROM g WHERE content <> ''""")
def markdown_sections(spark, sf_dir):
    out = ch.markdown_sections(markdown_of_conversations(spark, sf_dir), "conv_id")
    return out.select("conv_id", "chunk_type", F.col("chunk_index").cast("long"), "heading_path", F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.sha2("content", 256).alias("content_hash"))


_CODE = "'import sys' || chr(10) || chr(10) || 'def part_' || p_partkey || '():' || chr(10) || '    return ' || p_size || chr(10) || chr(10) || 'class Brand' || p_size || ':' || chr(10) || '    pass' || chr(10) || 'public static int size(int a) {' || chr(10) || '}' || chr(10)"


@query(f"""WITH t AS (SELECT p_partkey, {_CODE} AS text FROM part),
l AS (SELECT p_partkey, unnest(string_split(text[:-2], chr(10))) AS line, generate_subscripts(string_split(text[:-2], chr(10)), 1) AS n, len(string_split(text[:-2], chr(10))) AS total FROM t),
m AS (SELECT *, coalesce(nullif(regexp_extract(line, '{ch.SYMBOL_1}', 1), ''), nullif(regexp_extract(line, '{ch.SYMBOL_2}', 1), '')) AS symbol FROM l),
s AS (SELECT p_partkey, n, symbol, coalesce(lead(n) OVER (PARTITION BY p_partkey ORDER BY n) - 1, total) AS e, row_number() OVER (PARTITION BY p_partkey ORDER BY n) - 1 AS i FROM m WHERE symbol IS NOT NULL)
SELECT s.p_partkey, 'code_symbol' AS chunk_type, s.i AS chunk_index, s.symbol AS symbol_name, s.n AS start_line, s.e AS end_line, sha256(string_agg(l.line, chr(10) ORDER BY l.n)) AS content_hash
FROM s JOIN l ON l.p_partkey = s.p_partkey AND l.n BETWEEN s.n AND s.e GROUP BY ALL""")
def code_symbols(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    text = F.format_string("import sys\n\ndef part_%d():\n    return %d\n\nclass Brand%d:\n    pass\npublic static int size(int a) {\n}\n", "p_partkey", "p_size", "p_size")
    out = ch.code_symbols(p.select("p_partkey", text.alias("text")), "p_partkey")
    return out.select("p_partkey", "chunk_type", F.col("chunk_index").cast("long"), "symbol_name", F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.sha2("content", 256).alias("content_hash"))


@query(f"""WITH RECURSIVE a AS ({_LINES}), b AS (SELECT doc_id, l FROM a WHERE length(text) > 2000),
s AS (SELECT doc_id, c, len(l) AS n, l, list_sum(list_transform(l[1:c], lambda x: length(x) + 1)) AS before FROM (SELECT doc_id, l, unnest(range(0, len(l) + 1)) AS c FROM b)),
t AS (SELECT doc_id, c, n, coalesce(before, 0) AS before FROM s),
nx AS (SELECT x.doc_id, x.c, x.n, greatest(x.c + 1, max(CASE WHEN y.before - x.before <= 2000 THEN y.c END)) AS e FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.c >= x.c WHERE x.c < x.n GROUP BY x.doc_id, x.c, x.n),
w AS (SELECT doc_id, c, e, n, 0 AS piece FROM nx WHERE c = 0 UNION ALL SELECT nx.doc_id, nx.c, nx.e, nx.n, w.piece + 1 FROM w JOIN nx ON nx.doc_id = w.doc_id AND nx.c = greatest(w.e - 8, w.c + 1))
SELECT w.doc_id, w.piece::BIGINT AS piece, w.c + 1 AS start_line, w.e AS end_line, sha256(array_to_string(b.l[w.c + 1 : w.e], chr(10))) AS content_hash FROM w JOIN b USING (doc_id)
UNION ALL SELECT doc_id, 0, 1, greatest(len(l), 1), sha256(text) FROM a WHERE length(text) <= 2000""")
def split_long(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("start_line"), F.col("text").alias("content"))
    out = ch.split_long(d, ["doc_id"], max_chars=2000)
    return out.select("doc_id", F.col("piece").cast("long"), F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.sha2("content", 256).alias("content_hash"))


@query(f"""SELECT doc_id, len(l) AS line_count, CAST(greatest(1, length(text) // 4) AS BIGINT) AS token_estimate, sha256(text) AS content_hash, octet_length(encode(text)) AS byte_size FROM ({_LINES})""")
def chunk_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(tx.lines(F.col("text"))).cast("long").alias("line_count"), tx.token_estimate(F.col("text")).cast("long").alias("token_estimate"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("byte_size"))


# --- paths, keys, versions ----------------------------------------------------------------------

@query("SELECT content_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM (SELECT doc_id, sha256(text) AS content_hash FROM documents) GROUP BY content_hash")
def dedupe_by_content_hash(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


@query("SELECT doc_id, sha256(source || chr(0) || lower('Docs/' || lang || '/' || doc_id || '.MD') || chr(0) || n_chars || chr(0) || (doc_id * 1000)) AS idempotency_key FROM documents")
def idempotency_keys(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("Docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".MD"))
    return d.select("doc_id", px.idempotency_key(F.col("source"), path, F.col("n_chars"), F.col("doc_id") * 1000).alias("idempotency_key"))


_PATH = "CASE page_id % 6 WHEN 0 THEN 'node_modules/p' WHEN 1 THEN 'docs/p' WHEN 2 THEN 'src/build/p' WHEN 3 THEN 'p' ELSE 'src/p' END || page_id || CASE page_id % 5 WHEN 0 THEN '.exe' WHEN 1 THEN '.MD' WHEN 2 THEN '.py' ELSE '.json' END"


def page_files(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.expr(_PATH.replace("|| page_id ||", "|| cast(page_id as string) ||")).alias("path"), (F.char_length("html").cast("long") * 2000).alias("size_bytes"))


@query(f"""WITH f AS (SELECT {_PATH} AS path, length(html) * 2000 AS size_bytes FROM pages),
o AS (SELECT CASE WHEN regexp_matches(path, '(^|/)(node_modules|build)/') THEN 'ignored' WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) NOT IN ('.md', '.py', '.json') THEN 'unsupported' WHEN size_bytes > 10485760 THEN 'ignored' ELSE 'queued' END AS outcome FROM f)
SELECT count(*) AS visited, count_if(outcome = 'queued')::BIGINT AS queued, count_if(outcome = 'ignored')::BIGINT AS ignored, count_if(outcome = 'unsupported')::BIGINT AS unsupported, 0::BIGINT AS errors FROM o""")
def scan_stats(spark, sf_dir):
    return fl.scan_stats(page_files(spark, sf_dir).withColumn("outcome", fl.outcome_column(F.col("path"), F.col("size_bytes"))))


@query(f"""SELECT page_id, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix, string_split(path, '/')[-1] AS filename, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent,
 CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'root' END AS project_key, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.md' THEN 'text/markdown' WHEN '.py' THEN 'text/x-python' WHEN '.json' THEN 'application/json' ELSE 'text/plain' END AS mime_type
FROM (SELECT page_id, {_PATH} AS path FROM pages)""")
def path_attributes(spark, sf_dir):
    p, c = page_files(spark, sf_dir), F.col("path")
    return p.select("page_id", px.suffix(c).alias("suffix"), px.filename(c).alias("filename"), px.parent(c).alias("parent"), px.project_key(c, F.lit("root")).alias("project_key"), px.mime_type(c).alias("mime_type"))


@query("""WITH o AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version_id FROM events),
p AS (SELECT *, lag(version_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_version_id FROM o)
SELECT user_id, event_id AS version_id, event_type AS content_hash, previous_version_id, CASE WHEN previous_version_id IS NULL THEN 'created' ELSE 'modified' END AS change_type FROM p WHERE event_id = version_id""")
def version_history(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("content_hash"))
    return vs.history(e, "user_id", "content_hash", ["ts", "event_id"]).select("user_id", "version_id", "content_hash", "previous_version_id", "change_type")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS current_hash FROM events GROUP BY user_id")
def current_versions(spark, sf_dir):
    return vs.current(read(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("""SELECT c_mktsegment, count(*) AS n_chunks, count(DISTINCT o_orderkey) AS n_documents, round(sum(l_quantity), 2) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (SELECT o_custkey AS ck, max(o_orderkey) AS cur FROM orders GROUP BY 1) ON cur = o_orderkey JOIN customer ON c_custkey = ck GROUP BY c_mktsegment""")
def current_version_join(spark, sf_dir):
    """Orders are a customer's versions, the latest is current; line items are chunks, customers documents."""
    versions = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("document_id"))
    pointer = versions.groupBy("document_id").agg(F.max("version_id").alias("current_version_id"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("root_id"))
    roots = customers.select("root_id", F.col("root_id").alias("name")).distinct()
    chunks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    out = se.current_only(chunks, versions, customers.join(pointer, "document_id"), roots).withColumnRenamed("root_name", "c_mktsegment")
    return out.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("o_orderkey").alias("n_documents"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents), c AS (SELECT doc_id, CASE WHEN quality = 1 THEN sha256(text) ELSE sha256(lang) END AS ch, CASE WHEN toxic = 1 THEN 'deleted' ELSE 'active' END AS state FROM labels JOIN documents USING (doc_id)
 UNION ALL SELECT -l_orderkey, 'gone', CASE WHEN l_returnflag = 'R' THEN 'deleted' ELSE 'active' END FROM lineitem WHERE l_linenumber = 1)
SELECT CASE WHEN h IS NULL AND state = 'deleted' THEN 'none' WHEN h IS NULL THEN 'deleted' WHEN ch IS NULL THEN 'created' WHEN state = 'deleted' THEN 'restored' WHEN h = ch THEN 'unchanged' ELSE 'modified' END AS change_type, count(*) AS n
FROM s FULL JOIN c USING (doc_id) GROUP BY 1""")
def ingest_diff(spark, sf_dir):
    d, line = read(spark, sf_dir, "documents"), read(spark, sf_dir, "lineitem")
    scan = d.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    known = read(spark, sf_dir, "labels").join(d.select("doc_id", "text", "lang"), "doc_id")
    known = known.select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.col("lang")), 256).alias("current_hash"), F.when(F.col("toxic") == 1, "deleted").otherwise("active").alias("state"))
    gone = line.where("l_linenumber = 1").select((-F.col("l_orderkey")).alias("path"), F.lit("gone").alias("current_hash"), F.when(F.col("l_returnflag") == "R", "deleted").otherwise("active").alias("state"))
    return vs.diff(scan, known.unionByName(gone)).groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang AS parsed, 'p1' AS pipeline_version, source AS embedding_revision FROM documents")
def metadata_overlay(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    parsed = F.create_map(F.lit("lang"), F.col("lang"), F.lit("pipeline_version"), F.lit("from the text"))
    m = vs.metadata(parsed, {"pipeline_version": F.lit("p1"), "embedding_revision": F.col("source")})
    return d.select("doc_id", m.alias("m")).select("doc_id", F.col("m")["lang"].alias("parsed"), F.col("m")["pipeline_version"].alias("pipeline_version"), F.col("m")["embedding_revision"].alias("embedding_revision"))


# --- queue ----------------------------------------------------------------------------------------

def jobs(spark, sf_dir) -> DataFrame:
    """Orders as jobs: a fixed mapping of status, priority, attempts and times."""
    o = read(spark, sf_dir, "orders")
    date = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("idempotency_key"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("leased").alias("status"),
        F.substring("o_orderpriority", 1, 1).alias("priority"), (F.col("o_orderkey") % 5).cast("int").alias("attempt_count"), F.lit(4).alias("max_attempts"),
        date.alias("available_at"), F.timestamp_add("DAY", F.lit(30), date).alias("lease_expires_at"), date.alias("created_at"),
        F.lit(None).cast("string").alias("leased_by"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
    )


_JOBS = """j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'leased' END AS status, substring(o_orderpriority, 1, 1) AS priority, o_orderkey % 5 AS attempt_count, 4 AS max_attempts,
 o_orderdate AS available_at, o_orderdate + INTERVAL 30 DAY AS lease_expires_at, o_orderdate AS created_at FROM orders)"""
_ELIGIBLE = f"((status IN ('pending', 'failed') AND available_at <= TIMESTAMP '{NOW}') OR (status IN ('leased', 'processing') AND lease_expires_at < TIMESTAMP '{NOW}')) AND attempt_count < max_attempts"


@query(f"WITH {_JOBS} SELECT job_id, status, priority, strftime(available_at, '%Y-%m-%d') AS available_on FROM j WHERE {_ELIGIBLE} ORDER BY priority, available_at, created_at, job_id LIMIT 50")
def lease_candidates(spark, sf_dir):
    return jb.lease_candidates(jobs(spark, sf_dir), now(), 50).select("job_id", "status", "priority", F.date_format("available_at", "yyyy-MM-dd").alias("available_on"))


@query(f"""WITH {_JOBS}, t AS (SELECT job_id FROM j WHERE {_ELIGIBLE} ORDER BY priority, available_at, created_at, job_id LIMIT 3)
SELECT status, leased_by, count(*) AS n, sum(attempt_count)::BIGINT AS attempts, max(strftime(lease_expires_at, '%Y-%m-%d %H:%M:%S')) AS last_expiry FROM
 (SELECT CASE WHEN k THEN 'leased' ELSE status END AS status, CASE WHEN k THEN 'w1' END AS leased_by, attempt_count + k::INT AS attempt_count, CASE WHEN k THEN TIMESTAMP '{NOW}' + INTERVAL 90 SECOND ELSE lease_expires_at END AS lease_expires_at FROM (SELECT *, job_id IN (SELECT job_id FROM t) AS k FROM j)) GROUP BY 1, 2""")
def lease_apply(spark, sf_dir):
    out = jb.lease(jobs(spark, sf_dir), "w1", now(), 90, limit=3)
    return out.groupBy("status", "leased_by").agg(F.count(F.lit(1)).alias("n"), F.sum("attempt_count").alias("attempts"), F.max(F.date_format("lease_expires_at", "yyyy-MM-dd HH:mm:ss")).alias("last_expiry"))


@query(f"""WITH {_JOBS} SELECT job_id, CASE WHEN attempt_count >= max_attempts THEN 'dead_letter' ELSE 'failed' END AS status,
 CASE WHEN attempt_count >= max_attempts THEN strftime(available_at, '%Y-%m-%d %H:%M:%S') ELSE strftime(TIMESTAMP '{NOW}' + to_seconds(least(300, 2 * 2 ** greatest(attempt_count - 1, 0))::INT), '%Y-%m-%d %H:%M:%S') END AS due FROM j""")
def retry_backoff(spark, sf_dir):
    out = jb.failed(jobs(spark, sf_dir), now(), F.lit("x"))
    return out.select("job_id", "status", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("due"))


@query(f"""WITH {_JOBS} SELECT sha256('retry:' || job_id || ':1') AS job_id, 'retry:' || job_id || ':1' AS idempotency_key, 'pending' AS status, '{{"retry_of":"' || job_id || '"}}' AS error_details FROM j WHERE status = 'failed'""")
def retry_as_new(spark, sf_dir):
    out = jb.retry_as_new(jobs(spark, sf_dir).where("status = 'failed'"), F.lit("1"))
    return out.select("job_id", "idempotency_key", "status", "error_details")


@query("SELECT 'order:' || l_orderkey * 2 AS idempotency_key FROM lineitem WHERE l_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey")
def enqueue_idempotent(spark, sf_dir):
    new = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("order:"), (F.col("l_orderkey") * 2).cast("string")).alias("idempotency_key"))
    return jb.enqueue(jobs(spark, sf_dir), new)


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'leased' END AS status, count(*) AS n_jobs FROM orders GROUP BY 1")
def jobs_by_status(spark, sf_dir):
    return rp.grouped_count(jobs(spark, sf_dir), "status", "n_jobs")


@query(f"WITH {_JOBS} SELECT job_id, status, priority, attempt_count FROM j WHERE status = 'failed' ORDER BY created_at DESC, job_id LIMIT 25 OFFSET 50")
def jobs_page(spark, sf_dir):
    out = rp.page(jobs(spark, sf_dir).where("status = 'failed'"), [F.desc("created_at"), F.asc("job_id")], 3, 25)
    return out.select("job_id", "status", "priority", F.col("attempt_count").cast("long").alias("attempt_count"))


_LAST = "(SELECT max(ts) FROM events)"


@query(f"""SELECT user_id AS worker_id, CASE WHEN epoch_us({_LAST}) - epoch_us(max(ts)) > 36000 * 1000000::BIGINT THEN 'stale' ELSE arg_max(event_type, (ts, event_id)) END AS state, count_if(value >= 0)::BIGINT AS processed_count, count_if(NOT value >= 0)::BIGINT AS failed_count FROM events GROUP BY user_id""")
def workers_stale(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    beats = e.select(F.col("user_id").alias("worker_id"), F.col("event_id").alias("beat_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("state"), (F.col("value") >= 0).cast("long").alias("ok"), (~(F.col("value") >= 0)).cast("long").alias("bad"))
    last = beats.agg(F.max("ts").alias("t")).first()["t"]  # one value
    return jb.workers(beats, F.lit(last), 36_000).select("worker_id", "state", "processed_count", "failed_count")


# --- reports ----------------------------------------------------------------------------------------

@query("SELECT source AS project, count(*) AS n_documents FROM documents GROUP BY 1")
def projects_count(spark, sf_dir):
    return rp.grouped_count(read(spark, sf_dir, "documents").withColumnRenamed("source", "project"), "project", "n_documents")


@query("""WITH a AS (SELECT d.doc_id, source, n_chars FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1), n AS (SELECT count(*) AS total FROM a)
SELECT doc_id, source, n_chars, total FROM a, n ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20""")
def documents_page(spark, sf_dir):
    a = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id").select("doc_id", "source", "n_chars")
    shown = rp.page(a, [F.desc("n_chars"), F.asc("doc_id")], 2, 20)
    return shown.crossJoin(a.agg(F.count(F.lit(1)).alias("total")))  # one row


@query("""WITH r AS (SELECT split_part(url, '/', 3) AS host, url FROM pages ORDER BY url, host LIMIT 150)
SELECT host, array_to_string(list_sort(list(url))[1:250], '|') AS items, (SELECT count(*) = 150 FROM r) AS truncated FROM r GROUP BY host""")
def tree_listing(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.split("url", "/")[2].alias("host"), "url")
    return rp.tree(p, "host", "url", 150).select("host", F.array_join("items", "|").alias("items"), "truncated")


@query("""WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT target, count(*) AS n_links, count(DISTINCT page_id) AS n_sources FROM e GROUP BY target""")
def backlinks(spark, sf_dir):
    e = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return e.groupBy("target").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("page_id").alias("n_sources"))


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def timeline(spark, sf_dir):
    return read(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type", "user_id")


def _metrics(spark, sf_dir) -> DataFrame:
    d, e, j = read(spark, sf_dir, "documents"), read(spark, sf_dir, "events"), jobs(spark, sf_dir)
    age = rp.oldest_age_seconds(j, F.to_timestamp(F.lit("2002-01-01 00:00:00")))
    return d.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("projects")).crossJoin(e.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("user_id").alias("workers"))).crossJoin(age)  # one-row tables


_METRICS = f"""m AS (SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS projects, (SELECT count(*) FROM events) AS chunks, (SELECT count(DISTINCT user_id) FROM events) AS workers,
 coalesce((SELECT (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(min(created_at))) / 1000000 FROM j WHERE status = 'pending'), 0.0)::DOUBLE AS oldest_pending_seconds)"""


@query(f"WITH {_JOBS}, {_METRICS} SELECT * FROM m")
def metrics_summary(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query(f"""WITH {_JOBS}, {_METRICS}, s AS (SELECT string_agg('lodestone_jobs{{status="' || status || '"}} ' || n, chr(10) ORDER BY status) AS t FROM (SELECT status, count(*) AS n FROM j GROUP BY status))
SELECT '# TYPE lodestone_documents gauge' || chr(10) || 'lodestone_documents ' || documents || chr(10) || '# TYPE lodestone_chunks gauge' || chr(10) || 'lodestone_chunks ' || chunks || chr(10) ||
 '# TYPE lodestone_oldest_pending_seconds gauge' || chr(10) || 'lodestone_oldest_pending_seconds ' || oldest_pending_seconds::BIGINT || chr(10) || t || chr(10) AS exposition FROM m, s""")
def prometheus_export(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    none = F.lit(None).cast("string")
    gauges = None
    for i, name in enumerate(("documents", "chunks", "oldest_pending_seconds")):
        row = m.select(F.lit(i).alias("ord"), F.lit(name).alias("name"), none.alias("label"), F.col(name).cast("long").alias("value"))
        gauges = row if gauges is None else gauges.unionByName(row)
    by = jobs(spark, sf_dir).groupBy(F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("value"))
    return rp.exposition(gauges.unionByName(by.select(F.lit(9).alias("ord"), F.lit("jobs").alias("name"), "label", "value")), "lodestone")


@query("""SELECT user_id::VARCHAR AS path, arg_max(event_type, (ts, event_id)) AS change, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'watch_delete' ELSE 'watch_index' END AS job_type FROM events GROUP BY user_id""")
def watch_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("change"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.lit(1).cast("long").alias("size_bytes"), F.col("event_id").alias("mtime_ns"), (F.col("event_type") != "error").alias("seen"))
    return cs.classify(cs.merge_changes(e, ["ts", "event_id"])).select("path", "change", "job_type")


@query("""WITH damaged AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'),
r AS (SELECT 'rows:orders' AS "check", (SELECT count(*) FROM orders) AS expected, (SELECT count(*) FROM damaged) AS found
UNION ALL SELECT 'rows:lineitem', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'content:orders', 1, 0 UNION ALL SELECT 'content:lineitem', 1, 1
UNION ALL SELECT 'link:lineitem.l_orderkey', 0, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM damaged))
UNION ALL SELECT 'link:orders.o_custkey', 0, (SELECT count(*) FROM damaged WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'holds:orders.o_orderpriority:urgent', (SELECT count(*) FROM orders WHERE o_orderpriority ILIKE '%urgent%'), (SELECT count(*) FROM damaged WHERE o_orderpriority ILIKE '%urgent%'))
SELECT "check", expected, found, expected = found AS ok FROM r""")
def restore_check(spark, sf_dir):
    """A backup's manifest against a restored copy that has lost the pending orders and the links to them."""
    t = {n: read(spark, sf_dir, n) for n in ("orders", "lineitem")}
    restored = {**t, "orders": t["orders"].where("o_orderstatus <> 'P'"), "customer": read(spark, sf_dir, "customer")}
    links = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey")]
    probes = [("orders", "o_orderpriority", "urgent")]
    return vs.restore_check(vs.table_sums(t), restored, links, probes, vs.probe_counts(t, probes))
