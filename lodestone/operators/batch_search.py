"""Many searches at once: a table of queries against the lexical index and the vectors, and measures of their results.

Every query gets exactly the results that search.search() gives it. Queries are parsed into rows; a branch's candidates are the
chunks of its rarest term, by the counts in the block heads; the other terms' postings are joined to those candidates only; what
matches is ranked in its row; each query keeps its best by a limit inside the window, so a task's input is cut to that many rows
a query before anything is shuffled for ranks.

Rows: a null query finds nothing and is still a case. Repeated query ids are one query only if all is equal; ids should be distinct.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import lexical_index as li
from lodestone.operators import search as se

#: Queries whose vectors are sent to all tasks at once, at most; more go block by block.
BLOCK = 10_000


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, branch, words, phrases, without) of (query_id, query), by text.parse_search(); branches without a word that must occur fail."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], [[], [], [], []]
            for i, query in enumerate(batch.column("query").to_pylist()):
                for k, b in enumerate(tx.parse_search(query or "")):
                    if not b.terms:
                        raise ValueError("a branch of negations only matches nearly every chunk: search without the index")
                    rows.append(i)
                    for column, value in zip(found, (k, b.words, b.phrases, b.without), strict=True):
                        column.append(value)
            words, lists = pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))
            columns = [pa.array(c, k) for c, k in zip(found, (pa.int32(), words, lists, lists), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(rows, pa.int64())), *columns], names=["query_id", "branch", "words", "phrases", "without"])

    return queries.select("query_id", "query").mapInArrow(run, f"query_id {kind}, branch int, words array<string>, phrases array<array<string>>, without array<array<string>>")


def few(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """rows, some for each query: sent to all tasks where the queries are few, so that the index isn't shuffled to meet them."""
    return F.broadcast(rows) if queries.limit(BLOCK + 1).count() <= BLOCK else rows


def cover_rank(places: Column, terms: Column, asked: Column) -> Column:
    """text.cover_ranks() of one chunk and one branch in its row; 0.0 unless all its terms are there.

    places: a map of a term to its places; asked: the terms of all branches, which are no noise inside a cover.
    """
    events = F.array_sort(F.flatten(F.transform(F.filter(asked, lambda t: F.map_contains_key(places, t)), lambda t: F.transform(F.try_element_at(places, t), lambda p: F.struct(p.alias("pos"), t.alias("term"))))))
    begin = F.struct(F.transform(terms, lambda _: F.lit(None).cast("int")).alias("last"), F.lit(None).cast("int").alias("held"), F.lit(0.0).alias("rank"))

    def step(state: Column, event: Column) -> Column:
        last = F.transform(state["last"], lambda n, i: F.when(F.get(terms, i) == event["term"], event["nth"]).otherwise(n))
        first = F.when(~F.exists(last, lambda n: n.isNull()), F.array_min(last))  # a cover is named by the number of its first event
        noise = (event["pos"] - F.get(events, first)["pos"]) - (event["nth"] - first)
        new = first.isNotNull() & ~first.eqNullSafe(state["held"])
        rank = state["rank"] + F.when(new, F.lit(tx.WEIGHT) / (F.lit(1) + noise)).otherwise(0.0)
        return F.struct(last.alias("last"), first.alias("held"), rank.alias("rank"))

    numbered = F.transform(events, lambda e, n: F.struct(e["pos"].alias("pos"), e["term"].alias("term"), n.alias("nth")))
    return F.when(F.forall(terms, lambda t: F.map_contains_key(places, t)), F.aggregate(numbered, begin, step, lambda s: s["rank"])).otherwise(0.0)


def _has(m: Column, words: Column) -> Column:
    """Whether a phrase occurs: places where it may go on, word by word."""
    ends = F.aggregate(F.slice(words, 2, F.size(words)), F.try_element_at(m, words[0]), lambda held, w: F.array_intersect(F.transform(held, lambda p: p + 1), F.try_element_at(m, w)))
    return F.coalesce(F.size(ends) > 0, F.lit(False))


def text_ranks(index: li.LexicalIndex, queries: DataFrame, state: li.State) -> DataFrame:
    """(query_id, segment, chunk_id, lexical_rank) of the live chunks that match each query."""
    branches = parsed(queries).withColumn("terms", F.array_distinct(F.concat("words", F.flatten("phrases"))))
    whole = branches.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("branch", "terms", "phrases", "without"))).alias("b"))
    whole = whole.withColumn("asked", F.array_distinct(F.flatten(F.transform("b", lambda b: b["terms"]))))
    every = whole.select("query_id", F.explode(F.array_union("asked", F.flatten(F.flatten(F.transform("b", lambda b: b["without"]))))).alias("token"))
    blocks = index.rows("blocks", state).join(few(every.select("token").distinct(), queries), "token", "left_semi")
    terms = branches.select("query_id", "branch", F.explode("terms").alias("token"))
    heads = blocks.groupBy("token").agg(F.sum("n").alias("n"))
    rarest = terms.join(heads, "token", "left").groupBy("query_id", "branch").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token")).select("query_id", "token").distinct()
    candidates = index.alive(li.postings(blocks.join(few(rarest, queries), "token"), "query_id", "segment", "seq", "group"), state).select("query_id", "segment", "group", "chunk_id").distinct()
    keys = ["query_id", "segment", "chunk_id"]
    wanted = candidates.join(few(every, queries), "query_id")
    both = wanted.withColumn("group", F.explode(F.array("group", li._part(F.col("group")))))  # a block has one or the other
    held = both.groupBy("token", "segment", "group").agg(F.collect_set("chunk_id").alias("want"))  # of a part at most
    postings = li.postings(blocks.join(held, ["token", "segment", "group"]), "token", "segment", among="want")
    found = postings.join(wanted, ["token", "segment", "chunk_id"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("m"))
    m = F.col("m")

    def matches(b: Column) -> Column:
        return F.forall(b["terms"], lambda t: F.map_contains_key(m, t)) & F.forall(b["phrases"], lambda p: _has(m, p)) & ~F.exists(b["without"], lambda p: _has(m, p))

    full = found.join(whole, "query_id").where(F.exists("b", matches))
    # each branch whose terms are there counts, whichever branch it was that matched: as in the single search
    return full.select(*keys, F.aggregate(F.transform("b", lambda b: cover_rank(m, b["terms"], F.col("asked"))), F.lit(0.0), lambda x, y: x + y).alias("lexical_rank"))


def named_chunks(index: li.LexicalIndex, queries: DataFrame, state: li.State) -> DataFrame:
    """(query_id, chunk_id, path, query) of the live chunks whose path or symbol is like, contains or is a query."""
    lowered = F.lower("query")
    runs = F.filter(F.split(lowered, tx.NOT_TOKEN), lambda r: F.char_length(r) >= 3)
    inner = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 2), lambda i: F.substring(r, i, F.lit(3))))))
    asked = queries.where("query IS NOT NULL").select("query_id", "query", lowered.alias("lowered"), tx.trigrams(F.col("query")).alias("grams"), inner.alias("inner"))
    asked = asked.withColumn("m", F.size("grams"))
    names = index.rows("names", state)
    each = asked.where(F.size("inner") > 0).select("query_id", "m", F.size("inner").alias("asked"), "inner", F.explode(F.array_union("grams", "inner")).alias("gram"))
    each = each.select("query_id", "m", "gram", F.array_contains("inner", F.col("gram")).alias("within"))
    # a path like the query shares at least `least` of its m trigrams, so one of them even without the least - 1 commonest
    table = index.rows("grams", state)
    common = few(table.join(few(each.select("gram").distinct(), queries), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("paths")), queries)
    place, rare = Window.partitionBy("query_id").orderBy(F.desc("paths"), "gram"), Window.partitionBy("query_id").orderBy(F.desc("within"), "paths", "gram")
    left = F.expr("(3 * (m + (3 * m + 19) div 20) + 22) div 23 - 1")
    each = each.join(common, "gram", "left").withColumn("paths", F.coalesce("paths", F.lit(0))).select("*", left.alias("left"), (F.row_number().over(place) > left).alias("kept"), (F.row_number().over(rare) == 1).alias("rarest"))
    each = each.select("query_id", "m", "left", "gram", "kept", (F.col("rarest") & F.col("within")).alias("sure")).where("kept OR sure")
    like = (F.col("n") * 20 >= F.col("m") * 3) & (F.col("n") * 3 <= F.col("m") * 20)
    counted = table.join(few(each, queries), "gram").where((like & F.col("kept")) | F.col("sure")).groupBy("query_id", "segment", "chunk_id", "n", "m", "left").agg(F.count(F.when(F.col("kept"), 1)).alias("s"), F.max("sure").alias("sure"))
    near = counted.where((like & ((F.col("s") + F.col("left")) * 23 >= (F.col("n") + F.col("m")) * 3)) | F.col("sure")).select("query_id", "segment", "chunk_id")
    symbols = names.join(asked.select("query_id", "lowered"), F.col("symbol") == F.col("lowered")).select("query_id", "segment", "chunk_id")
    rows = near.unionByName(symbols).distinct().join(names, ["segment", "chunk_id"]).join(asked, "query_id")
    short = asked.where(F.size("inner") == 0)  # no three letters in a row: nothing to look up, so all paths
    if not short.isEmpty():
        rows = rows.unionByName(names.join(short), allowMissingColumns=True)
    pattern = "replace(lowered, '\\\\', '\\\\\\\\')"
    named = F.expr(f"lower(path) LIKE concat('%', {pattern}, '%')") | (F.col("symbol") == F.col("lowered")) | (tx.similarity(tx.trigrams(F.col("path")), F.col("grams")).cast("double") > tx.SIMILARITY_CUT)
    return index.alive(rows.where(F.coalesce(named, F.lit(False))), state).select("query_id", "chunk_id", "path")


def best(rows: DataFrame, order: list[Column], limit: int, rank: str) -> DataFrame:
    """Each query's first `limit` rows, numbered; the limit goes into the window, below its shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col(rank) <= limit)


def lexical(index: li.LexicalIndex, queries: DataFrame, limit: int, ranks: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, path_match, lexical_rank, similarity, lex_rank) of (query_id, query); see lexical_index.lexical().

    ranks: text_ranks() of these queries, where they are at hand.
    """
    state = index.state()
    hits = (text_ranks(index, queries, state) if ranks is None else ranks).join(index.rows("names", state).select("segment", "chunk_id", "path"), ["segment", "chunk_id"])
    both = hits.select("query_id", "chunk_id", "path", "lexical_rank").unionByName(named_chunks(index, queries, state).withColumn("lexical_rank", F.lit(None).cast("double")))
    rows = both.groupBy("query_id", "chunk_id", "path").agg(F.coalesce(F.max("lexical_rank"), F.lit(0.0)).alias("lexical_rank")).join(queries.select("query_id", "query"), "query_id")
    prefix = F.expr("lower(path) LIKE concat(replace(lower(query), '\\\\', '\\\\\\\\'), '%')").cast("int")
    rows = rows.select("query_id", "chunk_id", prefix.alias("path_match"), "lexical_rank", tx.similarity(tx.trigrams(F.col("path")), tx.trigrams(F.col("query"))).alias("similarity"))
    return best(rows, [F.desc("path_match"), F.round("lexical_rank", 9).desc(), F.desc("similarity"), F.asc("chunk_id")], limit, "lex_rank")


def nearest(embeddings: DataFrame, queries: DataFrame, limit: int, minimum: float | None = None) -> DataFrame:
    """(query_id, chunk_id, score, vec_rank) of (query_id, vector): search.nearest() of each, exact.

    One pass over embeddings (chunk_id, embedding) for each block of queries; a task keeps each query's best only. Vectors
    without a length or with a null or non-finite number have no score.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), embeddings.schema["chunk_id"].dataType.simpleString()
    held = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>"))
    blocks, out = max(1, -(-held.count() // BLOCK)), None
    for k in range(blocks):
        block = held if blocks == 1 else held.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        table = block.toArrow()  # a block
        names, vectors = table.column("query_id"), [np.array(v, float) for v in table.column("vector").to_pylist()]
        shared = embeddings.sparkSession.sparkContext.broadcast((pa.array(names.to_pylist(), names.type), vectors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, vectors = shared.value
            tops: list[list] = [[] for _ in vectors]
            kind = None
            for batch in batches:
                keys, kind, lists = batch.column("chunk_id").to_pylist(), batch.schema.field("chunk_id").type, batch.column("embedding")
                offsets, values = np.asarray(lists.offsets), np.asarray(lists.values.cast(pa.float64()).fill_null(np.nan))
                sizes, there = np.diff(offsets), np.asarray(lists.is_valid(), bool)
                for size in np.unique(sizes[there]):
                    rows = np.flatnonzero(there & (sizes == size))
                    x = values[offsets[rows][:, None] + np.arange(size)]
                    norms = np.sqrt((x * x).sum(1))
                    rows, x, norms = (a[np.isfinite(norms) & (norms > 0)] for a in (rows, x, norms))
                    for i, q in enumerate(vectors):
                        length = np.sqrt((q * q).sum()) if len(q) == size else 0.0
                        if not 0 < length < np.inf or not len(rows):
                            continue
                        scores = np.round(x @ q / (norms * length), 9)
                        near = np.flatnonzero(scores >= np.partition(scores, -limit)[-limit]) if len(scores) > limit else np.arange(len(scores))
                        own = [(-scores[j], keys[rows[j]] is not None, keys[rows[j]] or 0, keys[rows[j]]) for j in near]  # null keys first
                        tops[i] = heapq.nsmallest(limit, tops[i] + own, key=lambda t: t[:3])
            found = [(i, -t[0], t[3]) for i, top in enumerate(tops) for t in top]
            if found:
                at, scores, keys = zip(*found)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(keys, kind), pa.array(scores)], names=["query_id", "chunk_id", "score"])

        one = embeddings.select("chunk_id", "embedding").mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
        out = one if out is None else out.unionByName(one)
    top = best(out, [F.desc("score"), F.asc("chunk_id")], limit, "vec_rank")
    return top if minimum is None else top.where(F.col("score") >= minimum)


def fuse(lex: DataFrame, vec: DataFrame | None, top_k: int) -> DataFrame:
    """search.fuse() of each query."""
    part = lambda rank: F.coalesce(1.0 / (se.RRF + F.col(rank)), F.lit(0.0))
    if vec is None:
        both = lex.select("query_id", "chunk_id", "lex_rank", F.lit(None).cast("int").alias("vec_rank"))
    else:
        both = lex.select("query_id", "chunk_id", "lex_rank").join(vec.select("query_id", "chunk_id", "vec_rank"), ["query_id", "chunk_id"], "full_outer")
    rows = both.withColumn("fused", part("lex_rank") + part("vec_rank"))
    return best(rows, [F.desc("fused"), F.asc_nulls_last("lex_rank"), F.asc_nulls_last("vec_rank"), F.asc("chunk_id")], top_k, "rank")


def search(index: li.LexicalIndex, queries: DataFrame, embeddings: DataFrame | None = None, top_k: int = 10, minimum: float = se.MIN_SIMILARITY, ranks: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, lex_rank, vec_rank, fused, rank). queries: query_id, query and, with embeddings, vector: hybrid; else keyword."""
    se.bounded("top_k", top_k, 1, 100)
    lex = lexical(index, queries, se.OVERFETCH * top_k, ranks)
    vec = None if embeddings is None else nearest(embeddings, queries.select("query_id", "vector"), se.OVERFETCH * top_k, minimum)
    return fuse(lex, vec, top_k)


def cases(queries: DataFrame, results: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row a query: (query_id, answerable, first_rank, n_results), as search.retrieval_measures() takes them.

    relevant: (query_id, chunk_id), what answers a query; a query without any is one that has no answer.
    """
    good = relevant.select("query_id", "chunk_id").distinct().withColumn("good", F.lit(True))
    per = results.join(good, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.min(F.when(F.col("good"), F.col("rank"))).alias("first_rank"), F.count(F.lit(1)).alias("n_results"))
    known = good.select("query_id").distinct().withColumn("answerable", F.lit(True))
    return queries.select("query_id").join(known, "query_id", "left").join(per, "query_id", "left").select("query_id", F.coalesce("answerable", F.lit(False)).alias("answerable"), "first_rank", F.coalesce("n_results", F.lit(0)).alias("n_results"))
