"""Filters by state, revision, symbol and project, rows as listings show them, job turns and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import metadata as md
from lodestone.functions import vectors as vx
from lodestone.operators import catalog as ct
from lodestone.operators import jobs as jb
from lodestone.operators import reports as rp
from lodestone.operators import search as se
from lodestone.operators import store as st

from . import report_queries as rq
from . import search_queries as sq
from . import store_queries as wq
from .search_queries import read

Q: dict = {}
SQL: dict[str, str] = {}
SYMBOL = "fr"


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(sq.LEXICAL_SQL.replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"))
def search_active_only(spark, sf_dir):
    """A keyword search while the documents labelled toxic are deleted."""
    gone = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"), F.lit("deleted").alias("marked")).distinct()
    c = sq.chunks(spark, sf_dir).join(gone, "chunk_id", "left").withColumn("state", F.coalesce("marked", "state")).drop("marked")
    return sq._lexical(se.lexical(se.filtered(c), sq.WORDS, 3 * sq.K))


@query(f"""WITH toks AS ({sq._TOKS.replace("text, regexp", "text, lang, regexp").replace("lower(text)", "lower(concat_ws(' ', lang, text))")}),
scored AS (SELECT *, list_contains(toks, '{SYMBOL}') AS hit, lower(path) LIKE '%{SYMBOL}%' OR lower(lang) = '{SYMBOL}' AS named, CAST(lower(path) LIKE '{SYMBOL}%' AS INTEGER) AS path_match, {sq._sim(sq._grams("path"), sq._grams(f"'{SYMBOL}'"))} AS similarity FROM toks),
cand AS (SELECT * FROM scored WHERE hit OR named OR similarity::DOUBLE > 0.15), matched AS (SELECT * FROM cand WHERE hit), {sq._cover_sql([SYMBOL], "matched")}
SELECT doc_id, path_match, round(coalesce(lexical_rank, 0), 6) AS lexical_rank, round(similarity::DOUBLE, 5) AS similarity,
  row_number() OVER (ORDER BY path_match DESC, round(coalesce(lexical_rank, 0), 9) DESC, similarity DESC, doc_id) AS lex_rank FROM cand LEFT JOIN ranks USING (doc_id) QUALIFY lex_rank <= {3 * sq.K}""")
def symbol_search(spark, sf_dir):
    """Chunks whose symbol, here the language, is what was asked for, beside those that hold the word; a symbol is searched as text, too."""
    lang = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("symbol"))
    return sq._lexical(se.lexical(sq.chunks(spark, sf_dir).drop("symbol").join(lang, "chunk_id"), SYMBOL, 3 * sq.K))


@query(sq.VECTOR_SQL.replace("FROM embeddings))", "FROM embeddings WHERE label % 2 = 1))"))
def vector_by_revision(spark, sf_dir):
    """The nearest among the vectors of one revision, here the odd labels'."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("r"), (F.col("label") % 2).cast("string")).alias("embedding_revision"))
    near = se.nearest(e, sq.query_vector(spark, sf_dir), 3 * sq.K, revision="r1")
    return near.select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("vec_rank").cast("long").alias("vec_rank"))


@query("""WITH r AS (SELECT source, 'doc' || doc_id AS item FROM documents WHERE source = (SELECT min(source) FROM documents) ORDER BY item, source LIMIT 40)
SELECT source, array_to_string(list_sort(list(item))[1:250], '|') AS items, (SELECT count(*) = 40 FROM r) AS truncated FROM r GROUP BY source""")
def tree_of_project(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    first = d.agg(F.min("source").alias("s")).first()["s"] or ""  # one value
    return rp.tree(d.select("source", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("item")), "source", "item", 40, project=first).select("source", F.array_join("items", "|").alias("items"), "truncated")


@query("""SELECT lang, round(avg(CASE WHEN doc_id % 5 > 0 AND doc_id % 7 >= doc_id % 5 AND doc_id % 3 > 0 THEN 1.0 ELSE 0.0 END), 9) AS correct, count(*) AS n FROM documents GROUP BY lang""")
def citation_check(spark, sf_dir):
    """The share of structurally right citations by language; some lines and hashes are wrong on purpose."""
    n = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select("lang", (n % 5).alias("start_line"), (n % 7).alias("end_line"), F.when(n % 3 > 0, F.sha2("text", 256)).otherwise("none").alias("content_hash"), F.concat("source", F.lit("/x")).alias("path"))
    return rows.groupBy("lang").agg(F.round(se.citation_correctness(rows), 9).alias("correct"), F.count(F.lit(1)).alias("n"))


@query("""SELECT vec_id AS chunk_id, 'rev-' || 2 AS embedding_revision, len(embedding)::INTEGER AS dimension, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first_value FROM embeddings""")
def embedding_append(spark, sf_dir):
    """A unit vector of the size that is asked for, and its provenance, for every chunk; one vector of another size would stop it."""
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    size = e.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    out = st.new_embeddings(e, vx.normalise(vx.checked_dimension(F.col("embedding"), size)), size, "rev-2", "table", "m", "d")
    return out.select("chunk_id", "embedding_revision", "dimension", F.round(F.col("embedding")[0], 6).alias("first_value"))


@query(f"""WITH {rq._JOBS} SELECT job_id, CASE WHEN status = 'leased' THEN 'succeeded' ELSE status END AS status, CASE WHEN status = 'leased' THEN '{rq.NOW}' END AS finished_at, CASE WHEN status <> 'leased' THEN strftime(lease_expires_at, '%Y-%m-%d') END AS lease FROM j""")
def jobs_finished(spark, sf_dir):
    """All jobs, those that were leased finished."""
    j = rq.jobs(spark, sf_dir)
    done = jb.finished(j.where("status = 'leased'"), rq.now()).unionByName(j.where("status <> 'leased'"))
    return done.select("job_id", "status", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"), F.date_format("lease_expires_at", "yyyy-MM-dd").alias("lease"))


@query(f"""WITH {rq._JOBS}, t AS (SELECT job_id FROM j WHERE {rq._ELIGIBLE} ORDER BY priority, available_at, created_at, job_id LIMIT 40),
a AS (SELECT j.*, job_id IN (SELECT job_id FROM t) AS mine FROM j), b AS (SELECT *, mine AND job_id % 3 <> 1 AS told, attempt_count + mine::INT AS tries FROM a)
SELECT job_id, CASE WHEN NOT mine THEN status WHEN told AND job_id % 3 = 0 THEN 'succeeded' WHEN tries >= max_attempts THEN 'dead_letter' ELSE 'failed' END AS status, tries::BIGINT AS attempt_count,
 CASE WHEN NOT mine OR (told AND job_id % 3 = 0) THEN NULL WHEN told THEN 'boom ' || job_id ELSE 'not processed' END AS error_message FROM b""")
def work_turn(spark, sf_dir):
    """One turn of forty jobs: of three a job goes well, the next isn't returned and the last fails."""
    n = F.col("job_id")
    after, _ = jb.work(rq.jobs(spark, sf_dir), "w1", rq.now(), lambda mine: mine.where(n % 3 != 1).select("job_id", F.when(n % 3 == 2, F.concat(F.lit("boom "), n.cast("string"))).alias("error")), limit=40)
    return after.select("job_id", "status", F.col("attempt_count").cast("long").alias("attempt_count"), "error_message")


@query(f"""WITH {wq._MERGED}, {rq._JOBS} SELECT document_id, 'deleted' AS event_type, path, NULL AS original_job_id, NULL AS new_job_id FROM m WHERE t_gone AND state = 'active'
UNION ALL SELECT NULL, 'job_retry', NULL, CAST(job_id AS VARCHAR), sha256('retry:' || job_id || ':1') FROM j WHERE status = 'failed'""".replace("m AS (SELECT *,", "m AS (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS t_gone,").replace("t_gone AND state", "old IS NOT NULL AND t_gone AND state"))
def deletion_and_retry_events(spark, sf_dir):
    """Known documents of low quality go, failed jobs are tried anew: an event for each."""
    gone = read(spark, sf_dir, "labels").where("quality = 0").join(wq.scanned(spark, sf_dir), "doc_id").select("root_id", "path")
    jobs = rq.jobs(spark, sf_dir)
    events = st.deletion_events(wq.catalog(spark, sf_dir), gone, wq._now()).unionByName(st.retry_events(jobs, jb.retry_as_new(jobs.where("status = 'failed'"), F.lit("1")), wq._now()))
    return events.select("document_id", "event_type", "path", F.col("details")["original_job_id"].alias("original_job_id"), F.col("details")["new_job_id"].alias("new_job_id"))


@query(f"""WITH {wq._MERGED} SELECT version_id AS id, h AS content_hash, change_type, '2024-02-01T00:00:00.000000+00:00' AS detected_at, CAST({wq._LINES} AS INTEGER) AS line_count, 'p1' AS parser_version, NULL::VARCHAR AS chunker_version, 'p1' AS pipeline_version, NULL::VARCHAR AS diff_summary
FROM m WHERE old IS NULL OR old <> h""")
def version_rows(spark, sf_dir):
    """Versions with the nine fields of their listing."""
    p = st.projected(wq._versions(spark, sf_dir).withColumn("parser_version", F.lit("p1")), st.VERSION_ROW)
    return p.withColumn("pipeline_version", F.col("metadata")["pipeline_version"]).drop("metadata")


@query(f"""WITH {rq._JOBS} SELECT job_id AS id, CASE WHEN attempt_count >= max_attempts THEN 'dead_letter' ELSE 'failed' END AS status, 'scan' AS job_type, '/orders/' || job_id AS path, attempt_count::INTEGER AS attempt_count, max_attempts, NULL::VARCHAR AS leased_by, 'Timeout' AS error_type,
 'late ' || priority AS error_message, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at, CASE WHEN attempt_count >= max_attempts THEN '{rq.NOW.replace(" ", "T")}.000000+00:00' END AS finished_at FROM j WHERE status = 'failed'""")
def job_rows(spark, sf_dir):
    """Failed jobs with the eleven fields of their listing."""
    j = jb.failed(rq.jobs(spark, sf_dir).where("status = 'failed'"), rq.now(), F.concat(F.lit("late "), "priority"))
    j = j.withColumns({"job_type": F.lit("scan"), "canonical_path": F.concat(F.lit("/orders/"), F.col("job_id").cast("string")), "error_type": F.lit("Timeout")})
    return st.projected(j, st.JOB_ROW)


@query(f"WITH {wq._MERGED} SELECT path, document_id, version_id, CASE WHEN state = 'deleted' THEN 'deleted' ELSE 'active' END AS state, CASE WHEN old IS NULL THEN '2024' ELSE '2023' END AS first_seen, size_bytes FROM (SELECT *, strlen(text)::BIGINT AS size_bytes FROM m)")
def catalog_upkeep(spark, sf_dir):
    """A written catalog of what was known, after a scan of all documents and the deletion of those of toxic label."""
    kept = ct.Catalog(spark, sq._new_folder(spark, "catalog"))
    ct.create(kept, wq.catalog(spark, sf_dir))
    scan = wq.scanned(spark, sf_dir)
    ct.upsert(kept, scan.drop("doc_id", "text"), F.lit(wq.ROOT), wq._now())
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    ct.delete(kept, scan.join(toxic, "doc_id", "left_semi").select("root_id", "path"), wq._now())
    return kept.documents().select("path", "document_id", "version_id", "state", F.date_format("first_seen_at", "yyyy").alias("first_seen"), "size_bytes")


@query("""SELECT doc_id, lang AS language, source AS origin, n_chars AS chars, lang || ' ' || source AS second_tag, 'p1' AS pipeline_version, source AS kept, strlen(text)::BIGINT AS body_bytes FROM documents""")
def nested_metadata(spark, sf_dir):
    """Nested headers of all documents as VARIANT values, under keys of the pipeline that are laid over by path."""
    d = sq.widen(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text"))
    head = F.concat(F.lit("---\norigin:\n  name: "), "source", F.lit("\n  size: {chars: "), F.col("n_chars").cast("string"), F.lit("}\ntags:\n- "), "lang", F.lit("\n- '"), "lang", F.lit(" "), "source", F.lit("'\npipeline: {version: from the text}\n---\n"))
    text = F.concat(head, "text")
    v = d.select("doc_id", "source", F.octet_length("text").cast("long").alias("body_bytes"), md.frontmatter(text).alias("v"))
    v = v.select("doc_id", "body_bytes", md.overlay(F.col("v"), {"pipeline.version": F.lit("p1"), "origin.seen.kept": F.col("source")}).alias("v"))
    got = {"language": ("$.tags[0]", "string"), "origin": ("$.origin.name", "string"), "chars": ("$.origin.size.chars", "bigint"), "second_tag": ("$.tags[1]", "string"), "pipeline_version": ("$.pipeline.version", "string"), "kept": ("$.origin.seen.kept", "string")}
    return v.select("doc_id", "body_bytes", *[F.variant_get("v", at, kind).alias(name) for name, (at, kind) in got.items()])
