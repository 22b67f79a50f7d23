"""Operator 13: vector code compression; codebooks are fitted by exponion search.

A vector's entries become integers floor(256 x), the vector is cut into 16 equal parts, and each part is
replaced by the index of the nearest of 64 entries in that part's codebook. Search for the nearest entry starts
at the part's previous entry a, at distance d: an entry at most d away from the part is at most 2 d away from a,
so only the beginning of a's list of entries by distance is scanned, as far as 4 d**2 in squares (the rim
included). All distances are squared integers, so neither the radius nor a tie depends on rounding; of equally
near entries the lowest index is taken.

Codebooks start as the parts of the 64 smallest keys (ties by the integers themselves, nulls last; fewer
vectors give fewer entries). Each of two rounds assigns every part and replaces an entry by the floor of the
mean of its parts; unused entries stay. A round is one pass: rows are written with their codes, from which the
next search starts (the first starts at entry 0), and each task writes the sums of its parts beside them. What
the driver gets is the codebooks and 16 x 64 sums, whatever the number of vectors.

Rows: a null vector, and one with a null or non-finite entry, is dropped, as is one whose length isn't the most
common (the greatest of equally common ones). A length that 16 doesn't divide is filled with zeros. Entries
beyond 2**18 count as that, which keeps every sum of squares inside a long. Null and repeated keys are rows like
others; null labels are a label. An empty table gives no rows. Extra columns are not read; ones that clash with
those returned don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import widen

from .common import discard, materialize, small_batches, table
from .dense import dimension, floored, matrix, merged

SCALE, LIMIT = 256, 1 << 26
PARTS, ENTRIES, ROUNDS = 16, 64, 2


def cut(vectors: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(rows, parts, width) integers of float vectors."""
    x = floored(vectors, SCALE, LIMIT)
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


class Exponion:
    """Nearest entries of one codebook (entries, width): each entry's neighbours by distance, itself first."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
        places = np.arange(len(book))
        self.order = np.array([np.lexsort((places, places != i, row)) for i, row in enumerate(apart)])
        self.reach = np.take_along_axis(apart, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row of x, the lowest index of equally near ones."""
        best, at = ((x - self.book[start]) ** 2).sum(1), start.copy()
        radius = 4 * best
        live = np.arange(len(x))
        for rank in range(1, len(self.book)):
            live = live[self.reach[start[live], rank] <= radius[live]]  # lists are sorted: who is out stays out
            if not len(live):
                break
            entry = self.order[start[live], rank]
            d = ((x[live] - self.book[entry]) ** 2).sum(1)
            nearer = (d < best[live]) | ((d == best[live]) & (entry < at[live]))
            won = live[nearer]
            best[won], at[won] = d[nearer], entry[nearer]
        return at, best


def assign(parts: np.ndarray, books: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), both (rows, parts)."""
    found = [Exponion(book).nearest(parts[:, p], start[:, p]) for p, book in enumerate(books)]
    return tuple(np.stack(x, 1) for x in zip(*found, strict=True))


def part_sums(parts: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """(parts, entries, 1 + width): how many parts each entry has, and their sums."""
    n, places, width = parts.shape
    cell = codes + np.arange(places) * entries
    out = np.zeros((places * entries, 1 + width), np.int64)
    out[:, 0] = np.bincount(cell.ravel(), minlength=len(out))
    for w in range(width):
        np.add.at(out[:, 1 + w], cell.ravel(), parts[:, :, w].ravel())
    return out.reshape(places, entries, 1 + width)


def _add(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()


def _integers(vectors: DataFrame, key: str, vector: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """(key, label, cells, code) of the finite vectors, all codes 0, and the width of a part."""
    dims = dimension(vectors, vector)
    small_batches(vectors.sparkSession, 4096)
    kinds = [vectors.schema[c].dataType.simpleString() for c in (key, label)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = matrix(batch.column(2), dims)
            if not len(rows):
                continue
            cells = cut(found, parts).astype("<i4").reshape(len(rows), -1)
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([bytes(parts)] * len(rows), pa.binary())],
                names=["key", "label", "cells", "code"],
            )

    out = widen(vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), vector)).mapInArrow(run, f"key {kinds[0]}, label {kinds[1]}, cells binary, code binary")
    return out, -(-dims // parts)


def _pass(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with codes by these codebooks and their errors, in a written table that also has each task's sums."""
    small_batches(rows.sparkSession, 4096)
    places, entries, width = books.shape
    key, label = (rows.schema[c].dataType.simpleString() for c in ("key", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        names = ["key", "label", "cells", "code", "error", "sums"]
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = np.frombuffer(b"".join(batch.column("cells").to_pylist()), "<i4").astype(np.int64).reshape(-1, places, width)
            start = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).astype(np.int64).reshape(-1, places)
            codes, error = assign(parts, books, start)
            found = part_sums(parts, codes, entries)
            sums = found if sums is None else sums + found
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(error.sum(1)), pa.nulls(len(parts), pa.binary())], names=names)
        if sums is not None:
            none = [pa.nulls(1, batch.column(c).type) for c in names[:4]]
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=names)

    return materialize(rows.mapInArrow(run, f"key {key}, label {label}, cells binary, code binary, error long, sums binary"), "codes")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): key, label, code (bytes) and error of each finite vector; integers (parts, entries, width).

    entries is at most 256, as an index is one byte.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows, width = _integers(vectors, key, vector, label, parts)
    first = rows.select("key", "cells").orderBy(F.col("key").asc_nulls_last(), "cells").limit(entries).collect()  # at most 256
    books = np.frombuffer(b"".join(bytes(r["cells"]) for r in first), "<i4").astype(np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    written = None
    for _ in range(rounds if first else 0):
        after = _pass(rows, books)
        discard(written)
        written, rows = after, after.where("sums IS NULL").select("key", "label", "cells", "code")
        states = after.where("sums IS NOT NULL").select("sums")
        sums = np.frombuffer(merged(states, states.rdd.getNumPartitions(), _add), np.int64).reshape(parts, len(first), 1 + width)
        books = np.where(sums[:, :, :1] > 0, sums[:, :, 1:] // np.maximum(sums[:, :, :1], 1), books)
    if not first:
        return rows.select("key", "label", "code", F.lit(0).cast("long").alias("error")).limit(0), books
    last = _pass(rows, books)
    discard(written)
    return last.where("sums IS NULL").select("key", "label", "code", "error"), books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each finite vector of (vec_id, embedding, label)."""
    rows, books = compress(vectors)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    by = by.withColumnRenamed("label", "of")
    return rows.join(by, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("key").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


_ASSIGN = "SELECT id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT c.id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cells c JOIN {books} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL) GROUP BY ALL"
_UPDATE = "SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (SELECT c.part, a.entry, c.pos, CAST(floor(sum(c.x) / count(*)) AS BIGINT) AS x FROM cells c JOIN {codes} a ON a.id = c.id AND a.part = c.part GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos"

OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
cells AS MATERIALIZED (
  SELECT id, (i - 1) // (len(embedding) // 16) AS part, (i - 1) % (len(embedding) // 16) AS pos, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT part, id AS entry, pos, x FROM cells WHERE id < 64),
a0 AS MATERIALIZED ({_ASSIGN.format(books="b0")}), b1 AS MATERIALIZED ({_UPDATE.format(books="b0", codes="a0")}),
a1 AS MATERIALIZED ({_ASSIGN.format(books="b1")}), b2 AS MATERIALIZED ({_UPDATE.format(books="b1", codes="a1")}),
a2 AS MATERIALIZED ({_ASSIGN.format(books="b2")}),
coded AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
FROM coded JOIN kept USING (id)"""
