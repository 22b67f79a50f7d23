"""Operator 8: n-gram Jaccard self-join with rare-first prefix filtering.

1. A text's set is its distinct word shingles as 64-bit hashes. Texts with equal sets are one node
   (found by a 128-bit digest of the set), so exact copies cost one node however many there are.
2. One global order sorts shingles rare first. A shingle's rarity is estimated from its words': word
   occurrences are counted over all texts in a fixed number of hash cells (a one-row count sketch
   of bounded size), and the logarithms of its words' counts are added up. Shingles that more
   than HOT prefixes then have (a common line of rare words, say) go last, by their exact count, and
   the sets that had them in their prefix get another one. Any fixed order keeps the filter exact; a
   good one makes it fast.
3. Two sets that reach the threshold share a shingle among their first n - ceil(t n) + 1, and it is
   even among the first n - ceil(2 t n / (1 + t)) + 1 of the smaller set (its index prefix): only
   prefixes are shuffled, and a group of one shingle in which no index prefix has it is dropped.
4. No group is expanded into all its pairs: it pairs one pivot (the member whose rarest shingle is
   the least rare, as in an original that its copies have changed: mostly one for all their groups) with its other members. These pairs pass the length filter,
   the positional filter (what can still match after the shared place) and the suffix filter, and
   are verified once; verified pairs are kept and left out later. The suffix filter bounds the Hamming
   distance of two sets from below: first by parity bitmaps (two sets differ in at least as many
   shingles as their bitmaps in bits; a bitmap has BITS bits or half as many as its set has
   shingles, rounded up to a power of two, and the longer of two is folded), then, beside the
   texts, by splitting both sets at one shingle.
5. If the other members of a group aren't all connected by then and at most SMALL of them have its
   shingle in their index prefix, these are paired with the members: linear in the group. In a larger
   group all go to the next level, where sets are replaced by their differences from the pivot, D(x) = x xor p. Distances stay what they were, as
   x xor y = D(x) xor D(y), but what the members of a group have in common is gone. Two sets of n and m
   shingles at the threshold differ in at most h = (1 - t) / (1 + t) (n + m) shingles, so their
   differences share at least (|D(x)| + |D(y)| - h) / 2; unless both are linked with the pivot this
   is above 0, and the same prefix filter applies to the differences, in the order of exact counts: those shingles
   first that few members of the cluster have. A group is then a shingle within a cluster (the pivots
   so far); clusters lose their pivot at each level, so this ends. Every pair that reaches the
   threshold is verified or known to be connected: no component is split.

Rows: null text and texts without words have the empty set, link with nothing, and are their own
component. component_id is the least doc_id of the component; null doc_ids take part but don't
count for the minimum (a component of nulls only has null). Repeated rows come out as often as they
came in. Texts of any length are read whole. An empty table gives an empty table; other columns can be
carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lists, lower_ascii, materialize, mix, pieces, shingle_hashes, small_batches, span_hashes, text_buffers, texts, words_of
from .components import components

#: Cells of the word-count sketch: bounded, whatever the input (2**18 counts, 2 MB).
CELL_BITS = 18
#: Least bits of a set's parity bitmap.
BITS = 1024
#: A group with at most so many index members pairs them with its members at once.
SMALL = 32
#: Shingles that more prefixes have are put last in the order.
HOT = 32
#: Bytes of text that are turned into sets at a time.
PIECE = 1 << 20
_U = np.uint64
_ROUNDING = 1e-6


def needed(n, percent: int):
    """The least number of shingles of a set of n that a set at the threshold shares."""
    return -(-n * percent // 100)


def required(a, b, percent: int):
    """The least overlap o of sets of a and b with 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for _, data, offsets in pieces(batches, "text", PIECE):
        start, end, _ = words_of(data, offsets)
        words = span_hashes(lower_ascii(data), start, end)
        counts += np.bincount((words >> _U(64 - CELL_BITS)).astype(np.int64), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["cell", "c"])


def rarities(docs: DataFrame) -> np.ndarray:
    """A number for each cell that grows with the logarithm of its words' occurrences in all rows."""
    found = docs.select("text").mapInArrow(_cells, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(1 << CELL_BITS)
    counts[found["cell"].to_numpy(np.int64)] = found["c"].to_numpy(float)
    return np.rint(np.log2(counts + 1) * 64).astype(np.int64)


_SETS = "rid long, doc_id long, key binary, node binary, n long, lead long, prefix array<long>, bits array<long>"


def _prefixes(n: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, rid = shared.value, TaskContext.get().partitionId() << 36
        for rows, data, offsets in pieces(batches, "text", PIECE):
            row, hashes, rarity = shingle_hashes(lower_ascii(data), offsets, n, lambda w: cells[(w >> _U(64 - CELL_BITS)).astype(np.int64)])
            size = np.bincount(row, minlength=rows.num_rows)
            nodes = node_digests(row, hashes, size)
            order = np.lexsort((hashes, rarity, row))
            row, hashes = row[order], hashes[order]
            begin = np.concatenate(([0], np.cumsum(size)))
            lead = np.zeros(rows.num_rows, np.int64)
            lead[size > 0] = -rarity[order][begin[:-1][size > 0]]
            place = np.arange(len(row)) - begin[row]
            take = place < (size - needed(size, percent) + 1)[row]
            width = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(size, 2) / 2)).astype(np.int64))
            at = np.cumsum(width) - width
            odd = np.bincount(at[row] + (hashes & (width[row] - 1).astype(_U)).astype(np.int64), minlength=int(width.sum())) & 1
            bits = lists(np.packbits(odd.astype(np.uint8)).view("<i8"), np.repeat(np.arange(rows.num_rows), width // 64), rows.num_rows, pa.int64())
            prefix = lists(hashes[take].view(np.int64), row[take], rows.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rid + np.arange(rows.num_rows)), rows.column("doc_id"), rows.column("key"), nodes, pa.array(size), pa.array(lead), prefix, bits], names=["rid", "doc_id", "key", "node", "n", "lead", "prefix", "bits"])
            rid += rows.num_rows

    return run


def node_digests(row: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> pa.Array:
    """A 128-bit digest of each row's set, from two independent sums; null for empty sets."""
    begin = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros((len(size), 2), _U)
    for k, salt in enumerate((_U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F))):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(mix(hashes ^ salt), dtype=_U)))
        out[:, k] = mix(total[begin[1:]] - total[begin[:-1]] + size.astype(_U))
    raw = out.astype(">u8").tobytes()
    return pa.array([raw[16 * i : 16 * i + 16] if s else None for i, s in enumerate(size)], pa.binary())


def overlap_at_least(a: np.ndarray, b: np.ndarray, need: int, depth: int = 2) -> bool:
    """Whether two ascending arrays share at least `need` values.

    First the suffix filter: split both at the middle value of one; parts can't share more than
    the shorter of each. Only pairs that survive it are merged.
    """

    def bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
        if not depth or not len(x) or not len(y):
            return min(len(x), len(y))
        m = len(x) // 2
        k = int(np.searchsorted(y, x[m]))
        return bound(x[:m], y[:k], depth - 1) + bound(x[m:], y[k:], depth - 1)

    if bound(a, b, depth) < need:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return len(b) > 0 and int(np.count_nonzero(b[at] == a)) >= need


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts batches of two texts x and y a row so that each has at most PIECE bytes of both, or one row."""
    for batch in batches:
        ends = sum(text_buffers(batch.column(c))[1] for c in ("x", "y"))
        at = 0
        while at < batch.num_rows:
            end = min(max(int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def _sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The ascending shingles of each text."""
    data, offsets = text_buffers(column)
    row, hashes = shingle_hashes(lower_ascii(data), offsets, n)
    return np.split(hashes, np.searchsorted(row, np.arange(1, len(column))))


def _runs(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(where a value differs from the one before it, the number of each row's run): rows of one key mostly stand together."""
    values = column.to_numpy(zero_copy_only=False)
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return pa.array(fresh), np.cumsum(fresh) - 1


def _verify(n: int, percent: int):
    """Keeps the pairs (u, v) whose texts x and y reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _beside(batches):
            fresh, of = _runs(rows.column("u"))
            left, right = _sets(rows.column("x").filter(fresh), n), _sets(rows.column("y"), n)
            good = [overlap_at_least(left[k], b, int(required(len(left[k]), len(b), percent))) for k, b in zip(of.tolist(), right, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("u"), rows.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def difference(x: np.ndarray, p: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """(what only one of x and the pivot p has, length of its prefix, length of its index prefix)."""
    d = np.setxor1d(x, p, assume_unique=True)
    a, b, size, t = len(x), len(p), len(d), percent / 100
    least, shared = 1, (a + b - size) // 2
    if 100 * shared >= percent * (a + b - shared):  # linked with p: partners to look for aren't
        least = max(1, int(np.floor((size + (1 - t) / (1 + t) * (b - a)) / 2 - _ROUNDING)) + 1)
    probe = max(least, int(np.ceil(size - a * (1 - t) / t - _ROUNDING)))
    index = max(least, int(np.ceil(size - a * (1 - t) / (2 * t) - _ROUNDING)))
    return d, max(0, size - probe + 1), max(0, size - index + 1)


_DIFFERENCES = "token long, cluster long, node long, n long, d long, probe long, index long"


def _differences(n: int, percent: int):
    """Every shingle of the differences of (cluster, node, pnode), with the texts x of pnode and y of node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _beside(batches):
            fresh, of = _runs(rows.column("pnode"))
            pivots, members = _sets(rows.column("x").filter(fresh), n), _sets(rows.column("y"), n)
            cluster = mix(mix(rows.column("cluster").to_numpy().view(_U)) ^ rows.column("pnode").to_numpy().view(_U))
            found = [difference(x, pivots[k], percent) for k, x in zip(of.tolist(), members, strict=True)]
            sizes = np.array([len(f[0]) for f in found], np.int64)
            row = np.repeat(np.arange(len(found)), sizes)
            tokens = mix(np.concatenate([f[0] for f in found]) ^ cluster[row])
            own = [np.array(c, np.int64)[row] for c in ([len(x) for x in members], sizes, [f[1] for f in found], [f[2] for f in found])]
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(cluster.view(np.int64)[row]), rows.column("node").take(pa.array(row)), *map(pa.array, own)], names=[f.split()[0] for f in _DIFFERENCES.split(", ")])

    return run


def _next_level(whole: DataFrame) -> DataFrame:
    """The prefixes of differences by exact counts: what fewest members of a cluster have comes first.

    A shingle of one member takes a place in its prefix but isn't carried further.
    """
    counts = materialize(whole.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    own = Window.partitionBy("cluster", "node")
    ranked = whole.join(counts, "token").withColumn("k", F.row_number().over(own.orderBy("c", "token")) - 1).withColumn("all", F.count(F.lit(1)).over(own))
    placed = ranked.withColumn("at", (F.col("d") - F.col("all") + F.col("k")).cast("int")).where("at < probe")
    return placed.select("token", "cluster", "node", F.col("d").alias("lead"), "n", "d", "at", (F.col("at") < F.col("index")).alias("idx"))


def _tokens(n: int):
    """(node, token): every shingle of the texts of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text", PIECE):
            row, hashes = shingle_hashes(lower_ascii(data), offsets, n)
            yield pa.RecordBatch.from_arrays([rows.column("node").take(pa.array(row)), pa.array(hashes.view(np.int64))], names=["node", "token"])

    return run


def _late(n: int, percent: int, shared):
    """(node, at, token): the prefixes of texts of nodes if the shingles in `hot` (token, c) go last, by c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for rows, data, offsets in pieces(batches, "text", PIECE):
            row, hashes, rarity = shingle_hashes(lower_ascii(data), offsets, n, lambda w: cells[(w >> _U(64 - CELL_BITS)).astype(np.int64)])
            size = np.bincount(row, minlength=rows.num_rows)
            begin = np.concatenate(([0], np.cumsum(size)))
            hot, ends = rows.column("hot").flatten(), np.asarray(rows.column("hot").offsets)
            ends = ends - ends[0]
            token, c = np.asarray(hot.field("token")).view(_U), np.asarray(hot.field("c"))
            count = np.zeros(len(row), np.int64)
            for i in range(rows.num_rows):
                count[begin[i] + np.searchsorted(hashes[begin[i] : begin[i + 1]], token[ends[i] : ends[i + 1]])] = c[ends[i] : ends[i + 1]]
            order = np.lexsort((hashes, rarity, count, row))
            row, hashes = row[order], hashes[order]
            at = np.arange(len(row)) - begin[row]
            take = at < (size - needed(size, percent) + 1)[row]
            yield pa.RecordBatch.from_arrays([rows.column("node").take(pa.array(row[take])), pa.array(at[take].astype(np.int32)), pa.array(hashes[take].view(np.int64))], names=["node", "at", "token"])

    return run


def _index_length(percent: int):
    return F.expr(f"n - (({2 * percent} * n + {99 + percent}) div {100 + percent}) + 1")


def _demoted(tokens: DataFrame, texts_of, n: int, percent: int, shared) -> tuple[DataFrame, list[DataFrame]]:
    """tokens (node, at, token) of prefixes in an order that puts shingles that more than HOT prefixes have last.

    Only the sets with such a shingle in their prefix have another one then. Each gets the list of its own
    hot shingles, wherever in the order they stood.
    """
    hot = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT), "hot")
    other = materialize(tokens.join(hot.select("token"), "token", "left_semi").select("node").distinct(), "other")
    some = materialize(texts_of(other), "other-texts")
    own = some.mapInArrow(_tokens(n), "node long, token long").join(hot, "token").groupBy("node").agg(F.collect_list(F.struct("token", "c")).alias("hot"))
    again = materialize(some.join(own, "node").mapInArrow(_late(n, percent, shared), "node long, at int, token long"), "again")
    discard(some)
    return tokens.join(other, "node", "left_anti").unionByName(again), [hot, other, again]


def similar_components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node, n) of each row of docs (doc_id, text), and (node, component) of linked nodes.

    key is the text's MD5. A node is the number of one row with the set, null for empty sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(rarities(docs))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    rows = materialize(keyed.mapInArrow(_prefixes(n, percent, shared), _SETS), "prefixes")
    full = rows.where("n > 0")  # empty sets would meet under one null digest
    first = full.groupBy(F.col("node").alias("digest")).agg(F.min(F.struct("rid", "key", "doc_id")).alias("one"))
    # aggregates are written before they are joined: Spark then splits a key that many rows of the other side have
    first = materialize(first.select("digest", "one.rid", F.col("one.key").alias("k"), F.col("one.doc_id").alias("d")), "nodes")
    # one row a node from here on: copies neither crowd into a token's task nor make a token look shared
    nodes = materialize(full.select("rid", "n", "lead", "prefix", "bits").join(first.select("rid"), "rid", "left_semi"), "distinct")
    named = full.select("doc_id", "key", F.col("node").alias("digest"), "n").join(first.select("digest", F.col("rid").alias("node")), "digest").drop("digest")
    named = materialize(named.unionByName(rows.where("n = 0").select("doc_id", "key", "n", F.lit(None).cast("long").alias("node"))), "rows")
    discard(rows)

    def texts_of(some: DataFrame) -> DataFrame:
        """(node, text) of the nodes of `some` (node): one row's text for each."""
        one = first.join(some.withColumnRenamed("node", "rid"), "rid", "left_semi")
        found = keyed.join(one, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select(F.col("rid").alias("node"), "text")
        return found.mapInArrow(_first_of_each, "node long, text string")

    prefixes, used = _demoted(nodes.select(F.col("rid").alias("node"), F.posexplode("prefix").alias("at", "token")), texts_of, n, percent, shared)
    tokens = _shared(prefixes, nodes, percent)
    discard(*used)
    found = _link(tokens, texts_of, nodes.select("rid", "n", "bits"), n, percent)
    discard(nodes)
    if found is None:
        found = first.select(F.col("rid").alias("node"), F.col("rid").alias("component")).limit(0)
    return named, found


def _shared(prefixes: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The first level's groups: shingles that two prefixes have, one of them as index prefix."""
    counts = materialize(prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token"), "counts")
    kept = prefixes.join(counts, "token").join(nodes.select(F.col("rid").alias("node"), "n", "lead"), "node")
    kept = kept.select("token", F.lit(0).cast("long").alias("cluster"), "node", "lead", "n", F.col("n").alias("d"), "at", (F.col("at") < _index_length(percent)).alias("idx"))
    whole = materialize(kept, "groups")
    discard(counts)
    return whole


def _pairs(joined: DataFrame, percent: int) -> DataFrame:
    """Distinct (u, v), u < v, that pass the length and positional filters. joined: node, n, d, at and pnode, pn, pd, pat."""
    a, b = F.col("n"), F.col("pn")
    apart = a + b - 2 * F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))  # differences of sets at the threshold
    left = F.least(F.col("d") - F.col("at"), F.col("pd") - F.col("pat"))  # the shared shingle and what can follow it
    length = (F.lit(100) * F.least(a, b)) >= F.lit(percent) * F.greatest(a, b)
    # `left` bounds the overlap only at the first shared place, which a pair meets in some group
    ok = joined.where((F.col("node") != F.col("pnode")) & length).where(2 * (left + F.least("at", "pat")) >= F.col("d") + F.col("pd") - apart)
    return ok.select(F.least("node", "pnode").alias("u"), F.greatest("node", "pnode").alias("v")).distinct()


def _near_bitmaps(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps differ in no more bits than sets at the threshold differ in shingles."""
    a = bitmaps.select(F.col("rid").alias("u"), F.col("n").alias("a"), F.col("bits").alias("x"))
    b = bitmaps.select(F.col("rid").alias("v"), F.col("n").alias("b"), F.col("bits").alias("y"))
    words = F.least(F.size("x"), F.size("y"))

    def folded(c: str):
        parts = F.sequence(F.lit(0), F.col("words") - 1)
        fold = F.transform(parts, lambda i: F.aggregate(F.sequence(i, F.size(c) - 1, F.col("words")), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(F.get(F.col(c), k))))
        return F.when(F.size(c) == F.col("words"), F.col(c)).otherwise(fold)

    apart = F.aggregate(F.zip_with(folded("x"), folded("y"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    total = F.col("a") + F.col("b")
    need = F.ceil(F.lit(percent) * total / F.lit(100 + percent))
    return pairs.join(b, "v").join(a, "u").withColumn("words", words).where(apart <= total - 2 * need).select("u", "v")


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops copies of repeated rows, which a join by key has brought into one task."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for node in batch.column("node").to_pylist():
            fresh.append(node not in seen)
            seen.add(node)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _labelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows with comp, the component of their node so far."""
    if found is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(found.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _mixed(rows: DataFrame, *more) -> DataFrame:
    """Groups with members of different components."""
    return rows.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), *more).where("a <> b")


def _link(live: DataFrame, texts_of, bitmaps: DataFrame, n: int, percent: int) -> DataFrame | None:
    """(node, component) of nodes that link. live: token, cluster, node, lead, n, d, at, idx; cluster is 0, lead orders pivots."""
    texts = found = done = more = None
    while live is not None or more is not None:
        pairs, joined = more, None
        if live is not None:
            pivot = F.min(F.struct("lead", F.xxhash64("node").alias("h"), "node", "n", "d", "at", "comp")).alias("p")
            rows = _labelled(live, found)
            chosen = _mixed(rows, F.max("idx").alias("i"), pivot).where("i")
            chosen = materialize(chosen.select("token", *[F.col(f"p.{c}").alias(f"p{c}") for c in ("node", "n", "d", "at", "comp")]), "pivots")
            joined = materialize(rows.join(chosen, "token").where("node <> pnode"), "level")
            discard(live, chosen)
            pairs = _pairs(joined.where("comp <> pcomp"), percent)
            if more is not None:
                pairs = pairs.unionByName(more).distinct()
            if texts is None:  # one row's text for each node that shares a prefix shingle with another
                some = joined.select("node").unionByName(joined.select(F.col("pnode").alias("node"))).distinct()
                texts = materialize(texts_of(some), "texts")
        if done is not None:
            pairs = pairs.join(done, ["u", "v"], "left_anti")
        pairs = materialize(_near_bitmaps(pairs, bitmaps, percent), "pairs")
        discard(more)
        links = materialize(_beside_texts(pairs, texts, "u", "v").mapInArrow(_verify(n, percent), "u long, v long"), "links")
        if not links.isEmpty():
            old = found
            found = materialize(components(links if found is None else links.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))), "components")
            discard(old)
        discard(links)
        if joined is None:
            discard(pairs)
            break
        before = done
        done = pairs if before is None else materialize(before.unionByName(pairs), "done")
        discard(*([before, pairs] if before is not None else []))
        # what the pivots have not settled
        rest = _labelled(joined.select("token", "cluster", "node", "n", "d", "at", "idx", "pnode"), found)
        groups = materialize(_mixed(rest, F.count_if("idx").alias("i")).where("i > 0").select("token", (F.col("i") <= SMALL).alias("small")), "open")
        rest = materialize(rest.join(groups, "token"), "rest")
        discard(joined, groups)
        more = materialize(_within(rest.where("small"), percent), "within")
        moves = materialize(rest.where("not small").select("cluster", "node", "pnode").distinct(), "moves")
        discard(rest)
        live = None
        if not moves.isEmpty():
            whole = materialize(_beside_texts(moves, texts, "pnode", "node").mapInArrow(_differences(n, percent), _DIFFERENCES), "differences")
            live = materialize(_next_level(whole), "next")
            discard(whole)
        elif more.isEmpty():
            more = None
        discard(moves)
    discard(texts, done)
    return found


def _within(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs within groups of at most SMALL index members: each member meets these only."""
    index = rest.where("idx").select("token", *[F.col(c).alias(f"p{c}") for c in ("node", "n", "d", "at", "comp")])
    smaller = F.struct("pd", "pnode") < F.struct("d", "node")  # the index prefix is that of the smaller set
    return _pairs(rest.drop("pnode").join(index, "token").where((F.col("comp") != F.col("pcomp")) & smaller), percent)


def _beside_texts(pairs: DataFrame, texts: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with the text x of the node in `left` and y of that in `right`; only texts that are wanted are shuffled."""
    wanted = pairs.select(F.col(left).alias("node")).unionByName(pairs.select(F.col(right).alias("node"))).distinct()
    some = texts.join(wanted, "node", "left_semi")
    lefts = some.select(F.col("node").alias(left), F.col("text").alias("x"))
    rights = some.select(F.col("node").alias(right), F.col("text").alias("y"))
    return pairs.join(rights, right).join(lefts, left).select(*pairs.columns, "x", "y")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    rows, found = similar_components(docs, n, percent)
    joined = rows.where("n > 0").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    least = materialize(joined.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    out = joined.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(texts(spark, sf_dir, "doc_id", "text"), 4, 85)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT a AS doc_id, b AS reach FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT doc_id, min(reach) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
