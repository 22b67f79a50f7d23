"""What the operators on vectors share: Arrow lists as matrices, lengths, sums over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Rows or values at the end of one merging step, each of which one task takes.
FAN_IN = 32


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, ok) of a list column; ok: neither null itself nor with a null or non-finite entry."""
    offsets = np.asarray(column.offsets, np.int64)
    values = column.values
    bad = np.asarray(values.is_null(), bool)
    values = np.asarray(values.cast(pa.float64()).fill_null(0.0), np.float64)
    bad |= ~np.isfinite(values)
    before = np.concatenate(([0], np.cumsum(bad)))
    return values, offsets, np.asarray(column.is_valid(), bool) & (before[offsets[1:]] == before[offsets[:-1]])


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): the places of the finite vectors of `dims` entries (none of no entries), and these as float64."""
    values, offsets, ok = finite_rows(column)
    rows = np.flatnonzero(ok & (np.diff(offsets) == dims)) if dims else np.zeros(0, np.int64)
    return rows, values[offsets[rows][:, None] + np.arange(dims)]


def floored(vectors: np.ndarray, times: int, limit: int) -> np.ndarray:
    """floor(times * x) as int64; what is beyond the limit counts as the limit."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(times * vectors), -limit, limit).astype(np.int64)


def dimension(df: DataFrame, vector: str) -> int:
    """The length that most finite vectors have, the greatest of equally many; 0 where there are none."""
    small_batches(df.sparkSession, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets, ok = finite_rows(batch.column(0))
            size, n = np.unique(np.diff(offsets)[ok], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(n)], names=["size", "n"])

    found = df.select(vector).mapInArrow(run, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return found["size"] if found else 0


def merged(states: DataFrame, parts: int, merge: Callable[[bytes, bytes], bytes]) -> bytes | None:
    """All values of a binary column as one, merged FAN_IN at a time on the executors; null where there are none.

    parts: of how many partitions states is. Each holds a few values (one a task); the driver gets the last only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for state in batch.column(0).to_pylist():
                held = state if held is None else merge(held, state)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], names=["state"])

    states = states.mapInArrow(run, "state binary")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        states = states.repartition(parts).mapInArrow(run, "state binary")
    found = states.collect()
    return bytes(found[0]["state"]) if found else None
