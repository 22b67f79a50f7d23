"""Operator 11: embedding whitening by a one-sided Jacobi singular value decomposition.

A vector's entries c become integers x = floor(1024 c) + 100000, so that counts and sums are exact. Four steps:

1. n and the sums S of each dimension, as integers.
2. Blockwise TSQR: each task centres its rows, (n x - S) / n, and keeps only the triangle R of their QR
   decomposition; triangles are stacked and decomposed again, 32 at a time, until one is left. No covariance
   is ever formed, so small deviations aren't lost to the squares of large ones.
3. On that one triangle (dims x dims), plane rotations make the columns orthogonal, half of them at a time in
   tournament order, until none turns any more. The lengths of the columns are sqrt(n) times the standard
   deviations; the accumulated rotations are the components.
4. Rows are centred, projected and divided, and written with each task's own moments (count, mean, scatter
   about that mean), which are merged pairwise into the covariance of what was really returned.

Rows: a null vector, and one with a null or non-finite entry, is dropped, as is one whose length isn't the most
common (the greatest of equally common ones). Null and repeated vec_ids are rows like others. Entries beyond
2**52 / 1024 count as that. `deviation` is exact; one beyond the range of a long is given as the greatest long.
A component without variance (below the rounding of the greatest) has whitened 0 and so an identity_error of 1.
Vectors of fewer than 8 entries have as many components as entries. An empty table gives none. Extra columns
are not read; ones that clash with those returned don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import widen

from .common import materialize, small_batches, table
from .dense import dimension, floored, matrix, merged

SCALE, SHIFT, LIMIT = 1024, 100_000, 1 << 52
COMPONENTS = 8
LONGEST = (1 << 63) - 1
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """n vectors of the fit list, the sums of their integers, unit components as columns, standard deviations, shares."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray


def integers(vectors: np.ndarray) -> np.ndarray:
    return floored(vectors, SCALE, LIMIT) + SHIFT


def apart(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exact: int64 where it fits, else Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // max(n, 1) + 1)
    if 2 * n * most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squared_lengths(d: np.ndarray) -> np.ndarray:
    """Sums of squares of integer rows, exact; at most the greatest long."""
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
        return (d * d).sum(1)
    d = d.astype(object)
    return np.array([min(int(s), LONGEST) for s in (d * d).sum(1)], np.int64)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), by falling value: one-sided Jacobi.

    Columns are rotated in pairs until each pair is orthogonal to rounding. A round of the tournament rotates
    disjoint pairs at once; dims - 1 rounds (dims if odd) meet every pair.
    """
    dims = r.shape[1]
    a = np.vstack((r, np.zeros((max(0, dims - len(r)), dims))))
    norms = np.linalg.norm(a, axis=0)
    order = np.argsort(-norms, kind="stable")  # large columns first converge sooner
    v = np.eye(dims)[:, order]
    a = a[:, order].copy()
    ring = list(range(dims + dims % 2))
    tolerance, tiny = dims * np.finfo(float).eps, np.finfo(float).tiny
    turned, sweeps = dims > 1, 0
    while turned and sweeps < 100:
        turned, sweeps = False, sweeps + 1
        for _ in range(len(ring) - 1):
            pairs = [(min(p), max(p)) for p in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]) if max(p) < dims]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            i, j = np.array(pairs).T
            x, y = a[:, i], a[:, j]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            live = np.abs(gamma) > tolerance * np.sqrt(alpha * beta) + tiny
            if not live.any():
                continue
            turned = True
            i, j, alpha, beta, gamma = i[live], j[live], alpha[live], beta[live], gamma[live]
            with np.errstate(over="ignore"):  # an infinite one is no turn
                zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, i], m[:, j]
                m[:, i], m[:, j] = c * x - s * y, s * x + c * y
    size = np.linalg.norm(a, axis=0)
    order = np.argsort(-size, kind="stable")
    return size[order], v[:, order] / np.linalg.norm(v[:, order], axis=0)


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all finite vectors of the most common length; None where there are none."""
    spark, vectors = vectors.sparkSession, widen(vectors.select(vector))
    dims = dimension(vectors, vector)
    small_batches(spark, 4096)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, object)
        for batch in batches:
            _, found = matrix(batch.column(0), dims)
            x = integers(found)
            n += len(x)
            sums += (x if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object)).sum(0)  # at most 4,096 rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array([n] * dims, pa.int64()), pa.array([int(s) for s in sums], pa.decimal128(38, 0))], names=["dim", "n", "s"])

    found = vectors.mapInArrow(add, "dim long, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()  # dims rows
    if not found or not found[0]["n"]:
        return None
    n, sums = int(found[0]["n"]), tuple(int(r["s"]) for r in found)

    def triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for batch in batches:
            _, rows = matrix(batch.column(0), dims)
            r = np.linalg.qr(np.vstack((r, (apart(integers(rows), n, sums) / n).astype(float))), "r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["state"])

    def stack(a: bytes, b: bytes) -> bytes:
        return np.linalg.qr(np.vstack([np.frombuffer(x).reshape(-1, dims) for x in (a, b)]), "r").tobytes()

    r = np.frombuffer(merged(vectors.mapInArrow(triangle, "state binary"), vectors.rdd.getNumPartitions(), stack)).reshape(-1, dims)
    size, turns = jacobi(r)
    total = float((r * r).sum())
    k = min(components, dims)
    size = np.where(size > dims * np.finfo(float).eps * size[0], size, 0.0)[:k]
    return Whitening(n, sums, turns[:, :k].copy(), size / np.sqrt(n), size**2 / total if total else np.zeros(k))


def moments(w: np.ndarray) -> bytes:
    """Count, mean and scatter about the mean of rows, as bytes."""
    mean = w.mean(0)
    return np.concatenate(([float(len(w))], mean, ((w - mean).T @ (w - mean)).ravel())).tobytes()


def merge_moments(a: bytes, b: bytes) -> bytes:
    (n, *p), (m, *q) = np.frombuffer(a), np.frombuffer(b)
    k = int(np.sqrt(len(p) + 0.25))  # k + k * k numbers
    p, q = np.array(p), np.array(q)
    gap = q[:k] - p[:k]
    scatter = p[k:] + q[k:] + np.outer(gap, gap).ravel() * (n * m / (n + m))
    return np.concatenate(([n + m], p[:k] + gap * (m / (n + m)), scatter)).tobytes()


def project(vectors: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, float]:
    """(rows, identity error): key, deviation and whitened (a list) of each finite vector, in a written table.

    The error is the greatest entry of the covariance of all whitened rows less the identity; 0.0 without rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    dims, turns, k = len(model.sums), model.components, model.components.shape[1]
    over = np.where(model.deviations > 0, model.deviations, np.inf)
    kind = vectors.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows, found = matrix(batch.column(1), dims)
            if not len(rows):
                continue
            d = apart(integers(found), model.n, model.sums)
            w = (d / model.n).astype(float) @ turns / over
            held = moments(w) if held is None else merge_moments(held, moments(w))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(squared_lengths(d)), cells, pa.nulls(len(w), pa.binary())], names=["key", "deviation", "whitened", "moments"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.column(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.float64())), pa.array([held], pa.binary())], names=["key", "deviation", "whitened", "moments"])

    out = widen(vectors.select(key, vector)).mapInArrow(run, f"key {kind.simpleString()}, deviation long, whitened array<double>, moments binary")
    out = materialize(out, "whitened")
    states = out.where("moments IS NOT NULL").select("moments")
    whole = merged(states, states.rdd.getNumPartitions(), merge_moments)
    rows = out.where("moments IS NULL").select(F.col("key").alias(key), "deviation", "whitened")
    if whole is None:
        return rows, 0.0
    n, *rest = np.frombuffer(whole)
    return rows, float(np.abs(np.array(rest[k:]).reshape(k, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each finite vector and component from 1."""
    model = fit(vectors, vector)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT.replace("vec_id long", f"{key} {vectors.schema[key].dataType.simpleString()}"))
    rows, error = project(vectors, model, key, vector)
    shares = F.array(*[F.lit(float(e)) for e in model.explained])
    each = rows.select(key, "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return each.select(
        key, (F.col("pos") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
