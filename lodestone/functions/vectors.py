"""Vector expressions and the deterministic embedder."""

from __future__ import annotations

import hashlib
import json
import math
import random
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = F.when(norm(a) == 0, 1.0).otherwise(norm(a))
    return F.transform(a, lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def checked_dimension(a: Column, dimension: int) -> Column:
    """The vector itself; fails the query where its length is wrong."""
    return F.when(F.size(a) == dimension, a).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimension} numbers, got "), F.size(a).cast("string"))))


def seeded_vector(text: str, dimension: int) -> list[float]:
    draw = random.Random(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))
    values = [draw.uniform(-1.0, 1.0) for _ in range(dimension)]
    length = math.sqrt(sum(v * v for v in values)) or 1.0
    return [v / length for v in values]


def deterministic_embedder(dimension: int):
    """An Arrow-batched function of text; any function with this shape can take its place."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: seeded_vector(t or "", dimension))

    return embed


class DimensionMismatch(ValueError):
    """A provider's vectors have another size than configured."""


@dataclass(frozen=True)
class Embedder:
    """What stands beside stored vectors, and the function that makes them."""

    provider: str
    model: str
    digest: str
    dimension: int
    embed: Callable[[Column], Column]


def http_embedder(base_url: str, model: str, digest: str, dimension: int, batch: int = 64, timeout: float = 120, provider: str = "http") -> Embedder:
    """Vectors from a service: POST /api/embed with model and input, the answer's `embeddings` in the same order.

    Each Arrow batch is sent in requests of `batch` texts from the executors. Another number of vectors, or another
    size, stops the job.
    """

    def ask(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts}).encode()
        request = urllib.request.Request(f"{base_url.rstrip('/')}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            vectors = json.load(answer)["embeddings"]
        if len(vectors) != len(texts):
            raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
        if sizes := {len(v) for v in vectors} - {dimension}:
            raise DimensionMismatch(f"expected {dimension} numbers, got {sorted(sizes)}: index again")
        return vectors

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            plain = [t or "" for t in texts]
            yield pd.Series([v for at in range(0, len(plain), batch) for v in ask(plain[at : at + batch])], dtype=object)

    return Embedder(provider, model, digest, dimension, embed)


def choose_embedder(dimension: int, base_url: str | None = None, model: str = "", digest: str = "", deterministic: bool = False) -> Embedder:
    """The service's vectors, or deterministic ones for tests."""
    if deterministic or not base_url:
        return Embedder("deterministic-test", "sha256-prng", "test-v1", dimension, deterministic_embedder(dimension))
    return http_embedder(base_url, model, digest, dimension)
