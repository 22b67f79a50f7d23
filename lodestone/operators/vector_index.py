"""A coarse index over vectors: unit vectors in folders by their nearest centre.

Centres are fitted on a bounded sample; every vector is assigned and written. A search reads the cells whose centres are
nearest to the query; with all cells it is exact. Null vectors and those without a length have no direction and are left out,
as they have no similarity to anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that the centres are fitted on, at most, and rounds of fitting.
SAMPLE = 20_000
ROUNDS = 12


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    folder: str
    centres: np.ndarray

    def cells(self, query: list[float], probes: int) -> list[int]:
        """The `probes` cells nearest to a query."""
        q = np.asarray(query, float)
        return np.argsort(-(self.centres @ q), kind="stable")[:probes].tolist()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def fit(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit vectors by spherical k-means, begun at evenly spaced rows; the same for the same rows."""
    x = _unit(np.asarray(x, float))
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        used = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(used[:, None], _unit(sums), centres)
    return centres


def build(embeddings: DataFrame, folder: str, cells: int = 64, key: str = "chunk_id", vector: str = "embedding") -> VectorIndex:
    """Writes the index of embeddings (key, vector). One pass to assign; no vector meets the driver but the sample."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(key).alias("chunk_id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND exists(v, x -> x <> 0)")
    taken = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("v").toArrow()  # a bounded sample
    sample = np.array(taken.column("v").to_pylist(), float)
    centres = fit(sample, cells) if len(sample) else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            x = _unit(flat.reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, 1))
            cell = np.argmax(x @ shared.value.T, axis=1) if len(x) else np.zeros(0, np.int64)
            units = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), units, pa.array(cell.astype(np.int32))], names=["chunk_id", "v", "cell"])

    kind = dict(rows.dtypes)["chunk_id"]
    rows.mapInArrow(assign, f"chunk_id {kind}, v array<double>, cell int").write.partitionBy("cell").parquet(f"{folder}/vectors")
    return VectorIndex(spark, folder, centres)


def nearest(index: VectorIndex, query: list[float], limit: int, probes: int | None = None, minimum: float | None = None) -> DataFrame:
    """(chunk_id, score, vec_rank) by cosine, best first, from the `probes` nearest cells; None: from all, which is exact."""
    length = float(np.linalg.norm(query))
    unit = [float(x) / length for x in query] if length else [0.0] * len(query)
    rows = index.spark.read.parquet(f"{index.folder}/vectors")
    if probes is not None:
        rows = rows.where(F.col("cell").isin(index.cells(unit, probes)))
    # the query's numbers stand in the expression: one sum of products, compiled as a whole
    score = F.lit(0.0)
    for i, q in enumerate(unit):
        score = score + F.get("v", F.lit(i)) * F.lit(q)
    order = [F.desc("score"), F.asc("chunk_id")]
    top = rows.select("chunk_id", F.round(score, 9).alias("score")).orderBy(*order).limit(limit).withColumn("vec_rank", F.row_number().over(Window.orderBy(*order)))
    return top if minimum is None else top.where(F.col("score") >= minimum)
