"""Search, ranking, packing and evaluation over documents and embeddings, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import batch_search as bs
from lodestone.operators import graph_index as gi
from lodestone.operators import lexical_index as li
from lodestone.operators import search as se
from lodestone.operators import vector_index as vi
from lodestone.session import shared_dir, widen

WORDS = "that with"
PHRASE = '"in the"'
TERMS = ["that", "with", "the"]
K = 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-chunk files: the source is the project and the folder."""
    d = widen(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    path = F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("doc_id").alias("chunk_id"), path.alias("path"), F.col("text").alias("content"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("heading"), F.lit("active").alias("state"), F.col("source").alias("project"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str):
    """The first vector, as a literal: one row, whatever the table's size."""
    row = read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in (row[0] if row else [])])


_INDEXES: dict[tuple, object] = {}


def _kept(spark: SparkSession, sf_dir: str, table: str, build):
    """An index of a table, written once in an application for the files that the table has now."""
    key = (spark.sparkContext.applicationId, build, li.fingerprint(spark, f"{sf_dir.rstrip('/')}/{table}.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = build(spark, sf_dir)
    return _INDEXES[key]


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}/{name}"


def _build_lexical(spark: SparkSession, sf_dir: str) -> li.LexicalIndex:
    return li.append(li.LexicalIndex(spark, _new_folder(spark, "index")), chunks(spark, sf_dir))


def leg(spark, sf_dir) -> DataFrame:
    return li.lexical(_kept(spark, sf_dir, "documents", _build_lexical), WORDS, 3 * K)


def index_updates(spark, sf_dir):
    """A search after a life of changes: two appends, a replacement that changes every third text, a removal, a merge.

    Of five doc_ids the last two come with the second append; those that 3 divides are then replaced, those that 7 divides removed.
    """
    c, ids = chunks(spark, sf_dir), F.col("chunk_id")
    index = li.append(li.LexicalIndex(spark, _new_folder(spark, "index")), c.where(ids % 5 < 3))
    li.append(index, c.where(ids % 5 >= 3))
    first = index.state().segments[0][0]
    third = c.where(ids % 3 == 0)
    li.append(index, third.withColumn("content", F.concat_ws(" ", F.lit("with that and that with"), "content")), third.select("chunk_id"))
    li.merge(index, [first])
    li.remove(index, c.where(ids % 7 == 0).select("chunk_id"))
    return _lexical(li.lexical(index, WORDS, 3 * K))


def lexical_scan(spark, sf_dir):
    """The same search without the index: tokens of every text."""
    return _lexical(se.lexical(chunks(spark, sf_dir), WORDS, 3 * K))


def lexical_search(spark, sf_dir):
    return _lexical(leg(spark, sf_dir))


def _lexical(out: DataFrame) -> DataFrame:
    return out.select(F.col("chunk_id").alias("doc_id"), F.col("path_match").cast("int"), F.round("lexical_rank", 6).alias("lexical_rank"), F.round(F.col("similarity").cast("double"), 5).alias("similarity"), F.col("lex_rank").cast("long").alias("lex_rank"))


_TOKS = r"SELECT doc_id, source || '/doc' || doc_id || '.txt' AS path, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS toks FROM documents"


def _cover_sql(terms: list[str], docs: str) -> str:
    """CTEs ending in `ranks` (doc_id, lexical_rank) for an AND of terms over the CTE `docs`."""
    listed = ", ".join(f"'{t}'" for t in terms)
    latest = ", ".join(f"last_value(CASE WHEN term = '{t}' THEN pos END IGNORE NULLS) OVER w AS t{i}" for i, t in enumerate(terms))
    full = " AND ".join(f"t{i} IS NOT NULL" for i in range(len(terms)))
    least = ", ".join(f"t{i}" for i in range(len(terms)))
    return f"""hits AS (SELECT doc_id, pos, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM
      (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM {docs}) WHERE term IN ({listed})),
    seen AS (SELECT doc_id, pos, nth, {latest} FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    covers AS (SELECT doc_id, least({least}, {least}) AS b, min(pos) AS e FROM seen WHERE {full} GROUP BY 1, 2),
    noise AS (SELECT c.doc_id, c.b, (c.e - c.b + 1) - count(h.pos) AS n FROM covers c JOIN hits h ON h.doc_id = c.doc_id AND h.pos BETWEEN c.b AND c.e GROUP BY c.doc_id, c.b, c.e),
    ranks AS (SELECT doc_id, sum(0.1::DOUBLE / (1 + n)) AS lexical_rank FROM noise GROUP BY doc_id)"""


def _grams(e: str) -> str:
    words = rf"regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}]+')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def _sim(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))))::FLOAT"


def _lexical_cte(words: str, terms: list[str], hit: str, toks: str) -> str:
    """CTEs ending in `lex`, the best of a keyword search: `hit` says in SQL whether the tokens match."""
    return f"""toks AS ({toks}),
scored AS (SELECT *, ({hit}) AS hit, lower(path) LIKE '%{words}%' AS inside,
  CAST(lower(path) LIKE '{words}%' AS INTEGER) AS path_match, {_sim(_grams("path"), _grams(f"'{words}'"))} AS similarity FROM toks),
cand AS (SELECT * FROM scored WHERE hit OR inside OR similarity::DOUBLE > 0.15),
matched AS (SELECT * FROM cand WHERE hit),
{_cover_sql(terms, "matched")},
lex AS (SELECT doc_id, path_match, coalesce(lexical_rank, 0) AS lexical_rank, similarity,
  row_number() OVER (ORDER BY path_match DESC, round(coalesce(lexical_rank, 0), 9) DESC, similarity DESC, doc_id) AS lex_rank FROM cand LEFT JOIN ranks USING (doc_id)
  QUALIFY lex_rank <= {3 * K})"""


LEXICAL_CTE = _lexical_cte(WORDS, WORDS.split(), "list_contains(toks, 'that') AND list_contains(toks, 'with')", _TOKS)
LEXICAL_SQL = f"WITH {LEXICAL_CTE} SELECT doc_id, path_match, round(lexical_rank, 6) AS lexical_rank, round(similarity::DOUBLE, 5) AS similarity, lex_rank FROM lex"


COMPOUND = "2.0"
_RUNS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[-./@][\p{L}\p{N}]+)*')"
_PARTS = r"string_split_regex(r, '[-./@]')"
_COMPOUND_TOKS = rf"SELECT doc_id, source || '/doc' || doc_id || '.txt' AS path, text, flatten(list_transform({_RUNS}, lambda r: CASE WHEN len({_PARTS}) > 1 THEN list_concat([r], {_PARTS}) ELSE [r] END)) AS toks FROM documents"


def compound_tokens(spark, sf_dir):
    """Tokens of all documents with hosts, addresses and hyphenated words whole and by part."""
    d = widen(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.compound_tokens(F.col("text")).alias("toks"))
    return d.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.size(F.filter("toks", lambda t: t.rlike("[-./@]"))).cast("long").alias("n_compounds"), F.sha2(F.array_join("toks", " "), 256).alias("tokens_sha256"))


COMPOUND_TOKENS_SQL = f"SELECT doc_id, len(toks) AS n_tokens, len(list_filter(toks, lambda t: regexp_matches(t, '[-./@]'))) AS n_compounds, sha256(array_to_string(toks, ' ')) AS tokens_sha256 FROM ({_COMPOUND_TOKS})"


def _build_compounds(spark: SparkSession, sf_dir: str) -> li.LexicalIndex:
    return li.append(li.LexicalIndex(spark, _new_folder(spark, "index"), compounds=True), chunks(spark, sf_dir))


def compound_search(spark, sf_dir):
    """A keyword search for a compound, from an index that has compounds."""
    return _lexical(li.lexical(_kept(spark, sf_dir, "documents", _build_compounds), COMPOUND, 3 * K))


_COMPOUND_CTE = _lexical_cte(COMPOUND, [COMPOUND, *COMPOUND.split(".")], f"contains(' ' || array_to_string(toks, ' ') || ' ', ' {COMPOUND} {COMPOUND.replace('.', ' ')} ')", _COMPOUND_TOKS)
COMPOUND_SEARCH_SQL = LEXICAL_SQL.replace(LEXICAL_CTE, _COMPOUND_CTE)


def phrase_search(spark, sf_dir):
    d = widen(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.tokens(F.col("text")).alias("toks"))
    hit = d.where(tx.matches(F.col("toks"), tx.parse_search(PHRASE)))
    places = F.filter(F.sequence(F.lit(1), F.size("toks")), lambda i: (F.get("toks", i - 1) == "in") & (F.get("toks", i) == "the"))
    return hit.select("doc_id", F.size(places).cast("long").alias("n_phrases"))


UPDATES_SQL = LEXICAL_SQL.replace("FROM documents)", "FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN concat_ws(' ', 'with that and that with', text) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0))")


PHRASE_SQL = f"""WITH toks AS ({_TOKS}), p AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM toks)
SELECT a.doc_id, count(*) AS n_phrases FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'in' AND b.term = 'the' GROUP BY a.doc_id"""


def cover_density_rank(spark, sf_dir):
    d = widen(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.tokens(F.col("text")).alias("toks"))
    has_all = F.lit(True)
    for t in TERMS:
        has_all = has_all & F.array_contains("toks", t)
    return tx.cover_density(d.where(has_all), "doc_id", "toks", TERMS).select("doc_id", F.round("rank", 6).alias("lexical_rank"))


COVER_SQL = f"WITH toks AS ({_TOKS}), {_cover_sql(TERMS, 'toks')} SELECT doc_id, round(lexical_rank, 6) AS lexical_rank FROM ranks"


def websearch_filter(spark, sf_dir):
    """OR branches, a phrase and a negation in one search."""
    d = widen(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", tx.tokens(F.col("text")).alias("toks"))
    return d.where(tx.matches(F.col("toks"), tx.parse_search('"of the" -that or para con'))).select("doc_id")


WEBSEARCH_SQL = f"""WITH toks AS ({_TOKS}), j AS (SELECT *, ' ' || array_to_string(toks, ' ') || ' ' AS s FROM toks)
SELECT doc_id FROM j WHERE (contains(s, ' of the ') AND NOT list_contains(toks, 'that')) OR (list_contains(toks, 'para') AND list_contains(toks, 'con'))"""


def trigram_path_match(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    sim = tx.similarity(tx.trigrams(F.col("p_name")), tx.trigrams(F.lit("small rings")))
    return p.withColumn("s", sim).where(F.col("s").cast("double") > tx.SIMILARITY_CUT).select("p_partkey", F.round(F.col("s").cast("double"), 5).alias("similarity"))


TRIGRAM_SQL = f"SELECT p_partkey, round(s::DOUBLE, 5) AS similarity FROM (SELECT p_partkey, {_sim(_grams('p_name'), _grams(chr(39) + 'small rings' + chr(39)))} AS s FROM part) WHERE s::DOUBLE > 0.15"


def vector_topk(spark, sf_dir):
    near = se.nearest(embedded(spark, sf_dir), query_vector(spark, sf_dir), 3 * K)
    return near.select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("vec_rank").cast("long").alias("vec_rank"))


_COS = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9)"
VECTOR_SQL = f"SELECT vec_id, round(score, 6) AS score, vec_rank FROM (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS vec_rank FROM (SELECT vec_id, {_COS} AS score FROM embeddings)) WHERE vec_rank <= {3 * K}"


def _build_cells(spark: SparkSession, sf_dir: str) -> vi.VectorIndex:
    return vi.build(embedded(spark, sf_dir), _new_folder(spark, "cells"))


def vector_index_topk(spark, sf_dir):
    """The same from the index, all cells: exact."""
    row = read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    near = vi.nearest(_kept(spark, sf_dir, "embeddings", _build_cells), list(row[0]) if row else [], 3 * K)
    return near.select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("vec_rank").cast("long").alias("vec_rank"))


def _build_graph(spark: SparkSession, sf_dir: str) -> gi.GraphIndex:
    return gi.build(embedded(spark, sf_dir), _new_folder(spark, "graph"))


def vector_graph_topk(spark, sf_dir):
    """The ten nearest to every twentieth vector, from the graphs: approximate, so without SQL; a test has the recall."""
    asked = read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = gi.nearest_many(_kept(spark, sf_dir, "embeddings", _build_graph), asked, K)
    return near.select("query_id", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("vec_rank").cast("long").alias("vec_rank"))


def min_similarity_after_limit(spark, sf_dir):
    near = se.nearest(embedded(spark, sf_dir), query_vector(spark, sf_dir), 40, minimum=se.MIN_SIMILARITY)
    return near.select(F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"))


MIN_SIM_SQL = f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 40) WHERE score >= 0.2"


def _hybrid(spark, sf_dir, k=K):
    return se.search(chunks(spark, sf_dir), embedded(spark, sf_dir), WORDS, query_vector(spark, sf_dir), "hybrid", k, lex=leg(spark, sf_dir))


def hybrid_rrf(spark, sf_dir):
    out = _hybrid(spark, sf_dir)
    return out.select(F.col("chunk_id").alias("doc_id"), F.round("fused", 9).alias("fused"), F.array_join("match_reason", ",").alias("match_reason"), F.col("rank").cast("long").alias("rank"))


FILTERED_SQL = f"""WITH {LEXICAL_CTE.replace("FROM documents)", "FROM documents WHERE source = 'src3' AND lower(source || '/doc' || doc_id || '.txt') LIKE 'src3/doc1%')")}
SELECT doc_id, round(1.0::DOUBLE / (60 + lex_rank), 9) AS fused, lex_rank AS rank FROM lex WHERE lex_rank <= {K}"""
HYBRID_CTE = f"""{LEXICAL_CTE},
vec AS (SELECT * FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS vec_rank FROM
  (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))) WHERE vec_rank <= {3 * K} AND score >= 0.2),
fused AS (SELECT doc_id, coalesce(1.0::DOUBLE / (60 + lex_rank), 0) + coalesce(1.0::DOUBLE / (60 + vec_rank), 0) AS fused, lex_rank, vec_rank,
  concat_ws(',', CASE WHEN lex_rank IS NOT NULL THEN 'keyword/path match' END, CASE WHEN vec_rank IS NOT NULL THEN 'semantic similarity' END) AS match_reason FROM lex FULL JOIN vec USING (doc_id)),
top AS (SELECT *, row_number() OVER (ORDER BY fused DESC, lex_rank NULLS LAST, vec_rank NULLS LAST, doc_id) AS rank FROM fused QUALIFY rank <= {K})"""
HYBRID_SQL = f"WITH {HYBRID_CTE} SELECT doc_id, round(fused, 9) AS fused, match_reason, rank FROM top"


def search_results(spark, sf_dir):
    """Results as they are presented: file name, heading or symbol, snippet, provenance."""
    c = chunks(spark, sf_dir).withColumns({"start_line": F.lit(1), "end_line": F.lit(1), "source_root": F.col("project"), "document_id": F.col("chunk_id").cast("string"), "content_hash": F.sha2("content", 256)})
    out = se.present(_hybrid(spark, sf_dir), c)
    p = F.col("provenance")
    return out.select(F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "title", "heading_or_symbol", "snippet", F.round("fused_rank", 9).alias("fused"), "citation", p["relative_path"].alias("path"), p["source_root"].alias("source_root"), p["content_hash"].alias("content_hash"))


RESULTS_SQL = f"""WITH {HYBRID_CTE} SELECT doc_id, rank, 'doc' || doc_id || '.txt' AS title, NULL::VARCHAR AS heading_or_symbol, substring(text, 1, 800) AS snippet, round(fused, 9) AS fused,
 source || '/doc' || doc_id || '.txt:L1-L1' AS citation, source || '/doc' || doc_id || '.txt' AS path, source AS source_root, sha256(text) AS content_hash FROM top JOIN documents USING (doc_id)"""


def search_filtered(spark, sf_dir):
    """A keyword search within one project and below a path."""
    lex = se.search(chunks(spark, sf_dir), None, WORDS, None, "keyword", K, project="src3", path_prefix="SRC3/doc1")
    return lex.select(F.col("chunk_id").alias("doc_id"), F.round("fused", 9).alias("fused"), F.col("rank").cast("long").alias("rank"))


def search_log(spark, sf_dir):
    return se.query_log(_hybrid(spark, sf_dir), WORDS, "hybrid", 0)


def search_confidence(spark, sf_dir):
    return se.confidence(_hybrid(spark, sf_dir))


CONFIDENCE_SQL = f"WITH {HYBRID_CTE} SELECT count(*) AS n_results, CASE WHEN max(fused) IS NULL THEN 'none' WHEN max(fused) >= 1.0::DOUBLE / 61 THEN 'high' ELSE 'low' END AS confidence FROM top"


def rag_context(spark, sf_dir):
    packed = se.rag_context(chunks(spark, sf_dir), embedded(spark, sf_dir), WORDS, query_vector(spark, sf_dir), K, 5_000, lex=leg(spark, sf_dir))
    return packed.select(F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "running_chars", F.substring("content", 1, se.SNIPPET).alias("snippet"))


LOG_SQL = f"WITH {HYBRID_CTE} SELECT sha256('{WORDS}') AS query_hash, 'hybrid' AS mode, CAST(count(*) AS INTEGER) AS result_count, CAST(0 AS INTEGER) AS duration_ms FROM top"
RAG_SQL = f"""WITH {HYBRID_CTE}, r AS (SELECT doc_id, rank, text, CAST(sum(length(substring(text, 1, 800))) OVER (ORDER BY rank) AS BIGINT) AS running_chars FROM top JOIN documents USING (doc_id))
SELECT doc_id, rank, running_chars, substring(text, 1, 800) AS snippet FROM r WHERE running_chars <= 5000"""


def deterministic_embedding(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", vx.deterministic_embedder(64)("text").alias("embedding"))


def embedding_checks(spark, sf_dir):
    """Dimensions and norms of stored vectors, summed up by label."""
    e = read(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).cast("long").alias("least"), F.max(F.size("embedding")).cast("long").alias("most"), F.round(F.avg(vx.norm(F.col("embedding"))), 5).alias("mean_norm"))


EMBEDDING_SQL = "SELECT label, count(*) AS n, min(len(embedding)) AS least, max(len(embedding)) AS most, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS mean_norm FROM embeddings GROUP BY label"


def _eval_queries(spark, sf_dir) -> DataFrame:
    """Each benchmark item's words as a search (`or` would be an operator), and the vector with the item's number as its vector."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    words = F.array_remove(F.array_distinct(tx.tokens(F.coalesce("item", F.lit("")))), "or")
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return b.select("query_id", "item", F.array_join(words, " ").alias("query")).join(v, "query_id", "left")


def _eval_cases(spark, sf_dir, *modes: str) -> dict[str, DataFrame]:
    """The engine's ten best for every item, by mode; a document that holds the item whole is what it asks for."""
    asked = _eval_queries(spark, sf_dir)
    index = _kept(spark, sf_dir, "documents", _build_lexical)
    ranks = bs.text_ranks(index, asked, index.state()).persist()
    # what holds an item has its words, so all that match its search are the candidates
    pairs = ranks.select("query_id", F.col("chunk_id").alias("doc_id"))
    pairs = F.broadcast(pairs) if pairs.count() <= li.LISTED else pairs  # texts aren't shuffled to meet a few
    holds = pairs.join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").join(asked.select("query_id", "item"), "query_id")
    relevant = holds.where(F.col("text").contains(F.col("item"))).select("query_id", F.col("doc_id").alias("chunk_id"))
    return {m: bs.cases(asked, bs.search(index, asked, embedded(spark, sf_dir) if m == "hybrid" else None, K, ranks=ranks), relevant) for m in modes}


def retrieval_cases(spark, sf_dir):
    """The keyword evaluation, case by case."""
    return _eval_cases(spark, sf_dir, "keyword")["keyword"].select(F.col("query_id").alias("item_id"), "answerable", F.col("first_rank").cast("long").alias("first_rank"), "n_results")


def retrieval_eval(spark, sf_dir):
    """Measures of the engine's own searches, all items at once: a row for keyword search and one for hybrid."""
    out = None
    for mode, found in _eval_cases(spark, sf_dir, "keyword", "hybrid").items():
        m = se.retrieval_measures(found)
        m = m.select(F.lit(mode).alias("mode"), "n_cases", *[F.round(c, 9).alias(c) for c in ("hit_at_5", "hit_at_10", "mrr", "no_answer")])
        out = m if out is None else out.unionByName(m)
    return out


_EVAL_CTE = rf"""b AS (SELECT item_id, text AS item, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+')), lambda w: w <> 'or') AS words FROM benchmark),
asked AS MATERIALIZED (SELECT item_id, item, words, array_to_string(list_filter(list_transform(range(1, length(all_words) + 1), lambda i: CASE WHEN list_position(all_words, all_words[i]) = i AND all_words[i] <> 'or' THEN all_words[i] END), lambda w: w IS NOT NULL), ' ') AS q
  FROM (SELECT *, regexp_extract_all(lower(coalesce(item, '')), '[\p{{L}}\p{{N}}]+') AS all_words FROM b)),
d AS MATERIALIZED (SELECT doc_id, source || '/doc' || doc_id || '.txt' AS path, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS toks FROM documents),
pairs AS MATERIALIZED (SELECT item_id, doc_id, words, toks FROM asked JOIN d ON len(words) > 0 AND list_has_all(toks, words)),
hits AS MATERIALIZED (SELECT item_id, doc_id, pos, term, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS nth FROM
  (SELECT item_id, doc_id, words, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos FROM pairs) WHERE list_contains(words, term)),
ends AS (SELECT h.item_id, h.doc_id, h.pos, h.nth, unnest(p.words) AS term FROM hits h JOIN pairs p USING (item_id, doc_id)),
last AS (SELECT e.item_id, e.doc_id, e.pos AS e, e.nth, h.pos AS b, h.nth AS bn FROM ends e ASOF LEFT JOIN hits h ON e.item_id = h.item_id AND e.doc_id = h.doc_id AND e.term = h.term AND e.pos >= h.pos),
begun AS (SELECT item_id, doc_id, e, nth, min(b) AS b, min(bn) AS bn FROM last GROUP BY ALL HAVING count(*) = count(b)),
covers AS (SELECT item_id, doc_id, b, bn, min(e) AS e, min(nth) AS nth FROM begun GROUP BY item_id, doc_id, b, bn),
ranks AS (SELECT item_id, doc_id, sum(0.1::DOUBLE / (1 + (e - b) - (nth - bn))) AS rank FROM covers GROUP BY item_id, doc_id),
paths AS (SELECT item_id, doc_id, CAST(lower(path) LIKE q || '%' AS INTEGER) AS path_match, lower(path) LIKE '%' || q || '%' AS inside, {_sim("pg", "qg")} AS similarity
  FROM (SELECT item_id, q, {_grams("q")} AS qg FROM asked) CROSS JOIN (SELECT doc_id, path, {_grams("path")} AS pg FROM d)),
lex AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY path_match DESC, round(coalesce(rank, 0), 9) DESC, similarity DESC, doc_id) AS lex_rank
  FROM paths LEFT JOIN ranks USING (item_id, doc_id) WHERE rank IS NOT NULL OR inside OR similarity::DOUBLE > 0.15 QUALIFY lex_rank <= {3 * K}),
vec AS (SELECT item_id, doc_id, score, vec_rank FROM (SELECT item_id, v.vec_id AS doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score,
    row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS vec_rank
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN embeddings v) WHERE vec_rank <= {3 * K} AND score >= 0.2),
fused AS (SELECT 'keyword' AS mode, item_id, doc_id, lex_rank AS rank FROM lex WHERE lex_rank <= {K} UNION ALL
  SELECT 'hybrid', item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(1.0::DOUBLE / (60 + lex_rank), 0) + coalesce(1.0::DOUBLE / (60 + vec_rank), 0) DESC, lex_rank NULLS LAST, vec_rank NULLS LAST, doc_id) AS r
  FROM lex FULL JOIN vec USING (item_id, doc_id) QUALIFY r <= {K}),
relevant AS MATERIALIZED (SELECT item_id, doc_id FROM pairs JOIN d USING (doc_id) JOIN asked USING (item_id) WHERE contains(text, item)),
cases AS (SELECT mode, item_id, item_id IN (SELECT item_id FROM relevant) AS answerable, first_rank, coalesce(n_results, 0) AS n_results
  FROM (SELECT mode, item_id FROM benchmark CROSS JOIN (VALUES ('keyword'), ('hybrid')) m(mode)) LEFT JOIN
  (SELECT mode, f.item_id, min(CASE WHEN r.doc_id IS NOT NULL THEN rank END) AS first_rank, count(*) AS n_results FROM fused f LEFT JOIN relevant r ON r.item_id = f.item_id AND r.doc_id = f.doc_id GROUP BY ALL) USING (mode, item_id))"""
CASES_SQL = f"WITH {_EVAL_CTE} SELECT item_id, answerable, first_rank, n_results FROM cases WHERE mode = 'keyword'"
EVAL_SQL = f"""WITH {_EVAL_CTE} SELECT mode, count(*) AS n_cases, round(avg(CASE WHEN answerable THEN CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END END), 9) AS hit_at_5,
 round(avg(CASE WHEN answerable THEN CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0.0 END END), 9) AS hit_at_10,
 round(avg(CASE WHEN answerable THEN coalesce(1.0::DOUBLE / first_rank, 0) END), 9) AS mrr,
 round(avg(CASE WHEN NOT answerable THEN CAST(n_results = 0 AS DOUBLE) END), 9) AS no_answer FROM cases GROUP BY mode"""

QUERIES = {f.__name__: f for f in (lexical_search, lexical_scan, index_updates, compound_tokens, compound_search, phrase_search, cover_density_rank, websearch_filter, trigram_path_match, vector_topk, vector_index_topk, vector_graph_topk, min_similarity_after_limit, hybrid_rrf, search_results, search_filtered, search_log, search_confidence, rag_context, deterministic_embedding, embedding_checks, retrieval_cases, retrieval_eval)}
ORACLE_SQL = {
    "lexical_search": LEXICAL_SQL, "lexical_scan": LEXICAL_SQL, "index_updates": UPDATES_SQL, "compound_tokens": COMPOUND_TOKENS_SQL, "compound_search": COMPOUND_SEARCH_SQL, "phrase_search": PHRASE_SQL, "cover_density_rank": COVER_SQL, "websearch_filter": WEBSEARCH_SQL, "trigram_path_match": TRIGRAM_SQL,
    "search_results": RESULTS_SQL, "search_filtered": FILTERED_SQL, "search_log": LOG_SQL, "vector_topk": VECTOR_SQL, "vector_index_topk": VECTOR_SQL, "min_similarity_after_limit": MIN_SIM_SQL, "hybrid_rrf": HYBRID_SQL, "search_confidence": CONFIDENCE_SQL, "rag_context": RAG_SQL,
    "embedding_checks": EMBEDDING_SQL, "retrieval_cases": CASES_SQL, "retrieval_eval": EVAL_SQL,
}
