"""Operator 7: document fingerprints from prefix polynomial hashes.

A text's modular prefix arrays (two bases modulo 2**31 - 1) give the hash of any span in constant
time, so spans of texts compare without their bytes, and the longest common extension of two places
is found by binary search. The fingerprint holds the text's length, its whole-text hash and the
SKETCH least hashes of its SPAN-byte spans. Likeness is the Dice share of common spans, estimated
from the least hashes of both sketches together (bottom-k); equal texts give 1.

Rows are paired with the next document by descending doc_id: one range-partitioned sort; within a
partition rows pair as they stream by, and the first and last row of each partition are paired
across the edges afterwards.

Rows: null text counts as empty. Empty and empty are alike (1), empty and anything else are not (0).
Ties in doc_id are ordered by a hash of the text, null doc_ids come last; repeated rows are rows of
their own. Texts of any length are hashed whole, one at a time; extra columns are not carried. A table of one row pairs it with itself; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

PRIME = (1 << 31) - 1
BASES = (48271, 1_220_703_125)
SPAN = 16
SKETCH = 64
_U = np.uint64
_P = _U(PRIME)
_POWERS: dict[int, list[np.ndarray]] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x below 2**62."""
    x = (x & _P) + (x >> _U(31))
    x = (x & _P) + (x >> _U(31))
    return np.where(x >= _P, x - _P, x)


def _powers(n: int) -> list[np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        out = []
        for base in BASES:
            p = np.ones(1, _U)
            while len(p) < size:  # doubling: the second half is the first times base ** len
                p = np.concatenate((p, _mod(p * _U(pow(base, len(p), PRIME)))))
            out.append(p)
        if len(_POWERS) > 3:
            _POWERS.clear()
        _POWERS[size] = out
    return _POWERS[size]


class PrefixHashes:
    """Modular prefix arrays of one byte string."""

    def __init__(self, text: bytes, bases: int = 2) -> None:
        data = np.frombuffer(text, np.uint8).astype(_U) + _U(1)
        self.n, self.powers = len(data), _powers(len(data) + 1)
        self.sums = []
        for k in range(bases):
            s = np.zeros(self.n + 1, _U)
            np.cumsum(_mod(data * self.powers[k][: self.n]), out=s[1:])
            self.sums.append(_mod(s))

    def raw(self, k: int, start: int, end: int) -> int:
        return (int(self.sums[k][end]) - int(self.sums[k][start])) % PRIME

    def equal(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        """Whether this text's span at `start` and the other's at `at`, both of `length`, agree."""
        if min(start, at) < 0 or start + length > self.n or at + length > other.n:
            return False
        shift = abs(start - at)
        for k, base in enumerate(BASES[: min(len(self.sums), len(other.sums))]):
            a, b = self.raw(k, start, start + length), other.raw(k, at, at + length)
            factor = pow(base, shift, PRIME)
            if start < at:
                a = a * factor % PRIME
            else:
                b = b * factor % PRIME
            if a != b:
                return False
        return True

    def common_extension(self, start: int, other: PrefixHashes, at: int) -> int:
        """Length of the longest common prefix of the two suffixes."""
        low, high = 0, max(0, min(self.n - start, other.n - at))
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, width: int) -> np.ndarray:
        """A 32-bit hash of each span of `width` bytes; of the whole text if it is shorter."""
        width = min(width, self.n)
        if not width:
            return np.zeros(0, np.uint32)
        diff = self.sums[0][width:] + _P - self.sums[0][: self.n - width + 1]
        h = _mod(_mod(diff) * _inverse(len(diff))[: len(diff)])  # brought back to the power 0
        h = (h + _U(width)) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        return (h >> _U(32)).astype(np.uint32)


_INVERSES: dict[int, np.ndarray] = {}


def _inverse(n: int) -> np.ndarray:
    size = 1 << max(12, int(n).bit_length())
    if size not in _INVERSES:
        p, base = np.ones(1, _U), pow(BASES[0], -1, PRIME)
        while len(p) < size:
            p = np.concatenate((p, _mod(p * _U(pow(base, len(p), PRIME)))))
        if len(_INVERSES) > 3:
            _INVERSES.clear()
        _INVERSES[size] = p
    return _INVERSES[size]


def fingerprint_of(hashes: PrefixHashes) -> str:
    """Hex: length (8 bytes), whole-text hash (two of 4 bytes), then up to SKETCH span hashes (4 bytes each), ascending."""
    h = hashes.spans(SPAN)
    least, limit = np.zeros(0, np.uint32), 1 << 32
    if len(h) > 8 * SKETCH:
        limit = (1 << 32) * 3 * SKETCH // len(h)
    while True:
        least = np.unique(h[h < np.uint32(limit)] if limit < 1 << 32 else h)
        if len(least) >= SKETCH or limit >= 1 << 32:
            break
        limit *= 8
    head = hashes.n.to_bytes(8, "big") + b"".join(hashes.raw(k, 0, hashes.n).to_bytes(4, "big") for k in range(len(hashes.sums)))
    return (head + least[:SKETCH].astype(">u4").tobytes()).hex()


def fingerprint(text: bytes) -> str:
    return fingerprint_of(PrefixHashes(text))


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[32:]), ">u4") for s in (a, b))
    if not len(x) or not len(y):
        return 0.0
    # both sketches are full up to the smaller of their largest values, unless they hold all spans
    both = np.union1d(x, y)[:SKETCH] if max(len(x), len(y)) >= SKETCH else np.union1d(x, y)
    shared = np.intersect1d(np.intersect1d(both, x), y)
    j = len(shared) / len(both)
    return 2 * j / (1 + j)


_PAIR = "part int, kind string, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_bytes long, text string"


def _compare(doc_id, text: str, mine: str, hashes: PrefixHashes, after: str, theirs: str) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + after[:half]).encode()
    new = PrefixHashes(edited)
    changed = fingerprint_of(new)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, theirs), hashes.common_extension(0, new, 0))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in _PAIR.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each row of a sorted partition with the next; its first and last row also come out as edges."""
    part, held = TaskContext.get().partitionId(), None
    edge = lambda kind, doc_id, text: (part, kind, doc_id, *[None] * 7, text)
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            hashes = PrefixHashes(text.encode())
            mine = fingerprint_of(hashes)
            if held is None:
                out.append(edge("first", doc_id, text))
            else:
                out.append((part, "row", *_compare(*held, text, mine), None))
            held = (doc_id, text, mine, hashes)
        yield _batch(out)
    if held is not None:
        yield _batch([edge("last", held[0], held[1])])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True):
            hashes = PrefixHashes(text.encode())
            out.append((None, "row", *_compare(doc_id, text, fingerprint_of(hashes), hashes, after, fingerprint(after.encode())), None))
        if out:
            yield _batch(out)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): the fingerprints of its text and its edited text, and likenesses."""
    spark = docs.sparkSession
    small_batches(spark)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ranged.mapInArrow(_stream, _PAIR), "pairs")
    edges = rows.where("kind <> 'row'").select("part", "kind", "doc_id", "text")
    parts = sorted(r[0] for r in edges.where("kind = 'first'").select("part").collect())  # one number for each partition
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, then int")
    firsts = edges.where("kind = 'first'").select(F.col("part").alias("then"), F.col("text").alias("after"))
    lasts = edges.where("kind = 'last'").join(after, "part").join(firsts, "then").select("doc_id", "text", "after")
    return rows.where("kind = 'row'").unionByName(lasts.mapInArrow(_across, _PAIR)).drop("part", "kind", "text")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
