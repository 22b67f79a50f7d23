"""Approximate nearest vectors by small-world graphs, one for each part of the vectors.

Building: vectors are dealt to parts of bounded size, whatever their keys; a task links each distinct vector of its part to
near ones that lie in different directions (a neighbour is left out where one already taken is closer to it than the vector
is), links back, joins what is still apart, and the part is written as rows (part, node, unit vector, keys, links). Searching: a task holds one part and
answers all queries of a block, best first from the part's entries; each query's few best of every part are merged by rank.
What a graph saves is comparisons, about a tenth of all here, and the more the larger the parts; `ef` buys recall. The exact
way for any query is search.nearest().

Rows: null vectors, those with a null or non-finite number and those without a length have no direction and are left out, as
is one whose size isn't the most common. Equal vectors are one node with all their keys, so that copies can't fill a
neighbourhood. Null and repeated keys are rows like others. An empty table gives an index that finds nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors of a part, about: what one task links (by a blocked product of all pairs) and searches.
PART = 20_000
#: Links that a node makes, links back that it takes on, nearest ones that links are chosen from, entries of a part.
LINKS, BACK, NEAR, ENTRIES = 16, 16, 64, 24
#: Queries that are sent to all tasks at once, at most.
QUERIES = 10_000


@dataclass(frozen=True)
class GraphIndex:
    spark: SparkSession
    folder: str


def _nearest(x: np.ndarray, count: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities) of each row's `count` most similar others, best first."""
    count = min(count, len(x) - 1)
    at, sim = np.empty((len(x), count), np.int64), np.empty((len(x), count))
    for a in range(0, len(x), block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        best = np.argpartition(np.negative(s, out=s), count - 1, axis=1)[:, :count]
        held = -np.take_along_axis(s, best, 1)
        order = np.lexsort((best, -held), axis=1)
        at[a : a + block], sim[a : a + block] = np.take_along_axis(best, order, 1), np.take_along_axis(held, order, 1)
    return at, sim


def link(x: np.ndarray) -> list[np.ndarray]:
    """The links of each of some distinct unit vectors; every one can be reached from the entries."""
    n = len(x)
    if n <= 1:
        return [np.zeros(0, np.int64)] * n
    near, sim = _nearest(x, NEAR)
    own, taken = np.zeros((n, LINKS), np.int64), np.zeros(n, np.int64)
    for j in range(near.shape[1]):
        open_ = np.flatnonzero(taken < LINKS)
        for part in np.array_split(open_, max(1, len(open_) // 1024)):
            between = np.einsum("nd,nmd->nm", x[near[part, j]], x[own[part]])
            between[np.arange(LINKS) >= taken[part, None]] = -np.inf
            part = part[between.max(1) < sim[part, j]]
            own[part, taken[part]] = near[part, j]
            taken[part] += 1
    out = [row[:k] for row, k in zip(own, taken)]
    source, target = np.repeat(np.arange(n), taken), np.concatenate(out)
    order = np.lexsort((-np.einsum("nd,nd->n", x[source], x[target]), target))
    source, target = source[order], target[order]
    first = np.searchsorted(target, np.arange(n + 1))
    out = [np.unique(np.concatenate((o, source[a : min(b, a + BACK)]))) for o, a, b in zip(out, first[:-1], first[1:])]
    seen = np.zeros(n, bool)
    todo = entries(n).tolist()
    seen[todo] = True
    while True:
        while todo:
            fresh = out[todo.pop()]
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            todo += fresh.tolist()
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return out
        held = np.flatnonzero(seen)
        host = held[np.argmax(x[held] @ x[lost[0]])]
        out[host] = np.append(out[host], lost[0])
        seen[lost[0]] = True
        todo = [int(lost[0])]


def entries(n: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))


def best_first(x: np.ndarray, links: list[np.ndarray], q: np.ndarray, ef: int) -> tuple[list[tuple[float, int]], int]:
    """(the `ef` most similar nodes found as (similarity, node), best first; nodes compared)."""
    begin = entries(len(x))
    seen = np.zeros(len(x), bool)
    seen[begin] = True
    start = sorted(zip((x[begin] @ q).tolist(), begin.tolist()), reverse=True)
    found = [(s, -i) for s, i in start[:ef]]
    heapq.heapify(found)
    open_ = [(-s, i) for s, i in start]
    heapq.heapify(open_)
    while open_ and (len(found) < ef or -open_[0][0] >= found[0][0]):
        fresh = links[heapq.heappop(open_)[1]]
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        for s, i in zip((x[fresh] @ q).tolist(), fresh.tolist()):
            if len(found) < ef:
                heapq.heappush(found, (s, -i))
            elif (s, -i) > found[0]:
                heapq.heapreplace(found, (s, -i))
            else:
                continue
            heapq.heappush(open_, (-s, i))
    return sorted(((s, -i) for s, i in found), key=lambda f: (-f[0], f[1])), int(seen.sum())


def _units(rows: DataFrame, vector: str) -> DataFrame:
    """rows with `v`, the unit vector, of those that have one of the most common size."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = rows.where(F.coalesce(good, F.lit(False)))
    top = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size(vector) == (top["d"] if top else -1))
    greatest = F.array_max(F.transform(v, F.abs))  # keeps squares inside a double
    scaled = F.transform(v, lambda e: e / greatest)
    length = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, e: a + e * e))
    return rows.withColumn("v", F.transform(scaled, lambda e: e / length))


def build(embeddings: DataFrame, folder: str, key: str = "chunk_id", vector: str = "embedding", part: int = PART) -> GraphIndex:
    """Writes the index of embeddings (key, vector). One shuffle; no vector meets the driver."""
    spark = embeddings.sparkSession
    rows = _units(embeddings.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector").select("key", "v")
    parts = max(1, -(-rows.count() // part))
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))  # by place: copies of a key don't meet

    def graph(table: pa.Table) -> pa.Table:
        flat = table.column("v").combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        x, node = np.unique(x, axis=0, return_inverse=True)
        order = np.argsort(node.ravel(), kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(node.ravel(), minlength=len(x))))).astype(np.int32)
        links = link(x)
        at = np.concatenate(([0], np.cumsum([len(r) for r in links]))).astype(np.int32)
        columns = [
            pa.array(np.full(len(x), table.column("part")[0].as_py(), np.int32)), pa.array(np.arange(len(x), dtype=np.int32)),
            pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())),
            pa.ListArray.from_arrays(pa.array(ends), table.column("key").combine_chunks().take(pa.array(order))),
            pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(links).astype(np.int32))),
        ]
        return pa.Table.from_arrays(columns, names=["part", "node", "v", "keys", "links"])

    written = rows.groupBy("part").applyInArrow(graph, f"part int, node int, v array<double>, keys array<{kind}>, links array<int>")
    written.write.parquet(f"{folder}/graphs")
    return GraphIndex(spark, folder)


def _answers(index: GraphIndex, queries: DataFrame, limit: int, ef: int, query_id: str, vector: str) -> DataFrame:
    """(query_id, part, chunk_id, score, compared, vectors): every part's best of each query, and what they cost."""
    graphs = index.spark.read.parquet(f"{index.folder}/graphs")
    asked = _units(queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector")), "vector").select("query_id", "v")
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    parts = [r[0] for r in graphs.select("part").distinct().collect()]  # one small number a part
    every = asked.withColumn("part", F.explode(F.array(*[F.lit(p) for p in parts]).cast("array<int>")))  # each block meets each part once
    dealt = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = ["query_id", "part", "chunk_id", "score", "compared", "vectors"]
    kinds = asked.schema["query_id"].dataType.simpleString(), graphs.schema["keys"].dataType.elementType.simpleString()

    def search(part: pa.Table, block: pa.Table) -> pa.Table:
        found: list[list] = [[] for _ in names]
        if len(part) and len(block):
            part = part.sort_by("node")
            x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            keys, links = part.column("keys").to_pylist(), [np.array(r, np.int64) for r in part.column("links").to_pylist()]
            q = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
            for name, one in zip(block.column("query_id").to_pylist(), q if q.shape[1] == x.shape[1] else []):
                near, seen = best_first(x, links, one, max(ef, limit))
                rows = [(-round(s, 9), *k) for s, i in near for k in heapq.nsmallest(limit, ((k is None, 0 if k is None else k) for k in keys[i]))]
                for s, null, k in sorted(rows)[:limit]:
                    for column, value in zip(found, (name, part.column("part")[0].as_py(), None if null else k, -s, seen, len(x)), strict=True):
                        column.append(value)
        types = [block.schema.field("query_id").type, pa.int32(), part.schema.field("keys").type.value_type, pa.float64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(found, types, strict=True)], names=names)

    return dealt.groupBy("part", "block").cogroup(every.groupBy("part", "block")).applyInArrow(search, f"query_id {kinds[0]}, part int, chunk_id {kinds[1]}, score double, compared long, vectors long")


def nearest_many(index: GraphIndex, queries: DataFrame, limit: int, ef: int = 40, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
    """(query_id, chunk_id, score, vec_rank): each query's best by cosine, a score of 9 places, ties by key.

    A query without a direction finds nothing. Queries go to the tasks in blocks of at most QUERIES.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("chunk_id"))
    found = _answers(index, queries, limit, ef, query_id, vector).select("query_id", "chunk_id", "score")
    return found.withColumn("vec_rank", F.row_number().over(order)).where(F.col("vec_rank") <= limit)


def comparisons(index: GraphIndex, queries: DataFrame, limit: int, ef: int = 40, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
    """(query_id, compared, vectors): with how many distinct vectors a query was compared, of how many."""
    each = _answers(index, queries, limit, ef, query_id, vector).select("query_id", "part", "compared", "vectors").distinct()
    return each.groupBy("query_id").agg(F.sum("compared").alias("compared"), F.sum("vectors").alias("vectors"))
