"""Lexical, vector and rank-fused search, context packing and retrieval measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx

#: Fusion constant, over-fetch, defaults and bounds of requests.
RRF = 60
OVERFETCH = 3
MIN_SIMILARITY = 0.2
SNIPPET = 800


def bounded(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


#: What a result says about why it was found (fixed values).
REASONS = ("keyword/path match", "semantic similarity")
MODES = ("keyword", "hybrid", "path", "symbol", "semantic")


def filtered(chunks: DataFrame, project: str | None = None, path_prefix: str | None = None, source_root: str | None = None) -> DataFrame:
    """Active chunks; a predicate exists only where its argument is given, so it can be pushed down."""
    out = chunks.where(F.col("state") == "active") if "state" in chunks.columns else chunks
    if source_root is not None:
        out = out.where(F.col("source_root") == source_root)
    if project is not None:
        out = out.where(F.col("project") == project)
    if path_prefix is not None:
        out = out.where(F.lower("path").like(tx.like_literal(path_prefix).lower() + "%"))
    return out


def current_only(chunks: DataFrame, versions: DataFrame, documents: DataFrame, roots: DataFrame) -> DataFrame:
    """Chunks of the versions that documents now point to, with their document and root."""
    live = documents.join(roots.select(F.col("root_id"), F.col("name").alias("root_name")), "root_id")
    pointed = versions.join(live, F.col("version_id") == F.col("current_version_id")).drop(versions["document_id"])
    return chunks.join(pointed, "version_id")


def searched_text(chunks: DataFrame) -> Column:
    """Heading, symbol and content, where there is a heading column; else the content."""
    return F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.coalesce("symbol", F.lit("")), "content") if "heading" in chunks.columns else F.col("content")


def lexical(chunks: DataFrame, query: str, limit: int, compounds: bool = False) -> DataFrame:
    """(chunk_id, path_match, lexical_rank, similarity, lex_rank), best first. chunks: chunk_id, path, content, symbol.
    compounds: tokens and the search are those of text.compound_tokens().

    A chunk is a hit if its text matches the parsed search, its path contains the query or is like
    it, or its symbol is the query. Top-k comes before the rank window, so no task sorts all hits.
    """
    branches = tx.parse_search(query, compounds)
    lowered = query.lower()
    like = tx.like_literal(lowered)
    text = searched_text(chunks)
    terms = list(dict.fromkeys(t for b in branches for t in b.terms))
    maybe = F.lit(False)  # a text without any term as a substring isn't cut into tokens
    for t in terms:
        maybe = maybe | F.lower(text).contains(t)
    if any(not b.terms for b in branches):
        maybe = F.lit(True)
    base = chunks.select("chunk_id", "path", "symbol", F.when(maybe, tx.tokens_for(compounds)(text)).alias("toks"))
    wanted = tx.trigrams(F.lit(query))
    scored = base.select(
        "chunk_id", "toks", F.coalesce(tx.matches(F.col("toks"), branches), F.lit(False)).alias("hit"),
        F.lower("path").like(f"{like}%").cast("int").alias("path_match"), F.lower("path").like(f"%{like}%").alias("inside"),
        tx.similarity(tx.trigrams(F.col("path")), wanted).alias("similarity"), (F.lower(F.coalesce("symbol", F.lit(""))) == lowered).alias("named"),
    ).where(F.col("hit") | F.col("inside") | (F.col("similarity").cast("double") > tx.SIMILARITY_CUT) | F.col("named"))
    found = F.explode_outer(F.when(F.col("hit"), tx.places(F.col("toks"), terms)))
    rows = scored.select("chunk_id", "path_match", "similarity", found.alias("m")).select("chunk_id", "path_match", "similarity", "m.pos", "m.term")
    hits = tx.cover_ranks(rows, "chunk_id", [b.terms for b in branches if b.terms], ["path_match", "similarity"]).select("chunk_id", "path_match", F.col("rank").alias("lexical_rank"), "similarity")
    order = [F.desc("path_match"), F.round("lexical_rank", 9).desc(), F.desc("similarity"), F.asc("chunk_id")]
    return hits.orderBy(*order).limit(limit).withColumn("lex_rank", F.row_number().over(Window.orderBy(*order)))


def nearest(embeddings: DataFrame, query: Column, limit: int, revision: str | None = None, minimum: float | None = None, among: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score, vec_rank) by cosine; `minimum` applies after the limit, as a cut on its result.

    among: one column chunk_id, the only ones that count; scores are shuffled to meet it, not vectors.
    """
    rows = embeddings if revision is None else embeddings.where(F.col("embedding_revision") == revision)
    scored = rows.select("chunk_id", F.round(vx.cosine(F.col("embedding"), query), 9).alias("score"))
    scored = scored if among is None else scored.join(among, "chunk_id", "left_semi")
    order = [F.desc("score"), F.asc("chunk_id")]
    top = scored.orderBy(*order).limit(limit).withColumn("vec_rank", F.row_number().over(Window.orderBy(*order)))
    return top if minimum is None else top.where(F.col("score") >= minimum)


def fuse(lex: DataFrame, vec: DataFrame, top_k: int) -> DataFrame:
    """Reciprocal rank fusion of two short ranked lists; ties keep lexical hits first, in rank order."""
    both = lex.select("chunk_id", "lex_rank", *[c for c in ("lexical_rank",) if c in lex.columns]).join(vec.select("chunk_id", "score", "vec_rank"), "chunk_id", "full_outer")
    part = lambda rank: F.coalesce(1.0 / (RRF + F.col(rank)), F.lit(0.0))
    reasons = F.array_compact(F.array(F.when(F.col("lex_rank").isNotNull(), REASONS[0]), F.when(F.col("vec_rank").isNotNull(), REASONS[1])))
    fused = both.withColumn("fused", part("lex_rank") + part("vec_rank")).withColumn("match_reason", reasons)
    order = [F.desc("fused"), F.asc_nulls_last("lex_rank"), F.asc_nulls_last("vec_rank"), F.asc("chunk_id")]
    return fused.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def search(chunks: DataFrame, embeddings: DataFrame | None, query: str, vector: Column | None, mode: str = "hybrid", top_k: int = 10, minimum: float = MIN_SIMILARITY, revision: str | None = None, lex: DataFrame | None = None, **filters) -> DataFrame:
    """One search. keyword, path and symbol run the lexical leg, semantic the vector leg, hybrid both;
    without a query vector the vector leg is left out. filters: as filtered() takes them. lex: the lexical leg's
    OVERFETCH * top_k hits where an index has them, of the same filtered chunks."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if not -1 <= minimum <= 1:
        raise ValueError("minimum must be between -1 and 1")
    bounded("query length", len(query), 1, 500)
    bounded("top_k", top_k, 1, 100)
    chunks = filtered(chunks, **filters)
    lex = lexical(chunks, query, OVERFETCH * top_k) if lex is None else lex
    if mode == "semantic":
        lex = lex.limit(0)
    if vector is None or embeddings is None or mode not in ("semantic", "hybrid"):
        vec = lex.select("chunk_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("vec_rank")).limit(0)
    else:
        vec = nearest(embeddings, vector, OVERFETCH * top_k, revision, minimum, chunks.select("chunk_id"))
    return fuse(lex, vec, top_k)


def present(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results (of one search, so at most 100) with the file's name as title, heading or symbol, snippet and provenance.

    chunks: chunk_id, path, content, heading, symbol, start_line, end_line, and what there is of document_id,
    version_id, source_root, canonical_path, content_hash and detected_at; the rest is null.
    """
    have = set(chunks.columns)
    at = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    heading = F.coalesce(F.nullif("heading", F.lit("")), F.nullif("symbol", F.lit("")))
    provenance = F.struct(
        at("document_id").alias("document_id"), at("version_id").alias("version_id"), "chunk_id", at("source_root").alias("source_root"), at("canonical_path").alias("canonical_path"),
        F.col("path").alias("relative_path"), "start_line", "end_line", at("content_hash").alias("content_hash"), at("detected_at").cast("string").alias("indexed_timestamp"),
    )
    kept = chunks.select(
        "chunk_id", F.substring_index("path", "/", -1).alias("title"), heading.alias("heading_or_symbol"), F.substring("content", 1, SNIPPET).alias("snippet"), provenance.alias("provenance"),
        F.format_string("%s:L%d-L%d", "path", "start_line", "end_line").alias("citation"),
    )
    scores = [c for c in ("lexical_rank", "score") if c in results.columns]
    return F.broadcast(results).join(kept, "chunk_id").select("rank", "chunk_id", "title", "heading_or_symbol", "snippet", *scores, F.col("fused").alias("fused_rank"), "match_reason", "provenance", "citation")


def rag_context(chunks: DataFrame, embeddings: DataFrame | None, query: str, vector: Column | None, top_k: int = 5, max_chars: int = 12_000, lex: DataFrame | None = None, **filters) -> DataFrame:
    """Snippets of a hybrid search, best first, for as long as they fit."""
    bounded("top_k", top_k, 1, 30)
    results = search(chunks, embeddings, query, vector, "hybrid", top_k, lex=lex, **filters)
    return pack_context(F.broadcast(results).join(chunks.select("chunk_id", "content"), "chunk_id"), max_chars)


def response(presented: DataFrame, query: str, mode: str) -> DataFrame:
    """(json): one row with the whole answer, of at most 100 results, best first."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*[c for c in presented.columns if c != "rank"]).alias("r")))), lambda x: x["r"])
    best = F.max("fused_rank")
    sure = F.when(best.isNull(), "none").when(best >= 1.0 / (RRF + 1), "high").otherwise("low")
    one = presented.agg(items.alias("results"), sure.alias("confidence"), F.count(F.lit(1)).alias("total"))
    return one.select(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(mode).alias("mode"), "confidence", "results", "total"), {"ignoreNullFields": "false"}).alias("json"))


def query_log(results: DataFrame, query: str, mode: str, duration_ms: int) -> DataFrame:
    """One row for the search log: the query's hash, never its words."""
    counted = results.agg(F.count(F.lit(1)).cast("int").alias("result_count"))
    return counted.select(F.sha2(F.lit(query), 256).alias("query_hash"), F.lit(mode).alias("mode"), "result_count", F.lit(duration_ms).alias("duration_ms"))


def confidence(results: DataFrame) -> DataFrame:
    """One row: none without results, high from the score of a first rank on, else low."""
    best = F.max("fused")
    return results.agg(F.count(F.lit(1)).alias("n_results"), F.when(best.isNull(), "none").when(best >= 1.0 / (RRF + 1), "high").otherwise("low").alias("confidence"))


def pack_context(results: DataFrame, max_chars: int) -> DataFrame:
    """The longest run of results from the first on whose snippets fit. results: rank, content (few rows)."""
    bounded("max_chars", max_chars, 1000, 100_000)
    running = F.sum(F.char_length(F.substring("content", 1, SNIPPET)).cast("long")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("running_chars", running).where(F.col("running_chars") <= max_chars)


def retrieval_measures(ranks: DataFrame, hits: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row. ranks: answerable, first_rank (null: missed), n_results."""
    asked = F.col("answerable")
    mean = lambda c: F.avg(F.when(asked, c))
    found = [mean(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in hits]
    mrr = mean(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr")
    silent = F.avg(F.when(~asked, (F.col("n_results") == 0).cast("double"))).alias("no_answer")
    return ranks.agg(F.count(F.lit(1)).alias("n_cases"), *found, mrr, silent)


def citation_correctness(results: DataFrame) -> Column:
    good = (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")) & (F.char_length("content_hash") == 64) & (F.col("path") != "")
    return F.coalesce(F.avg(good.cast("double")), F.lit(1.0))
