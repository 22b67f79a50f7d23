"""What the training-data operators share: Arrow batches, rolling hashes, tables in the shared folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.session import shared_dir, widen

#: Characters that separate words: space and U+0009 to U+000D. bytes.split() splits at these exactly.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents, in at least as many partitions as there are cores."""
    return widen(table(spark, sf_dir, "documents").select(*columns))


def materialize(df: DataFrame, tag: str, level: int = 3) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, lost executors lose nothing. level: of zstd."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that materialize() wrote, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_lodestone_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Keeps Arrow batches small: texts may be long, and a batch is held whole on both sides.

    Plans are run after this returns, so the session keeps these two settings.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], name: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches so that each has at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(name))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


# --- hashing -------------------------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
#: Spans of more bytes are hashed by blake2b, one by one.
LONG_SPAN = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64's): a bijection in which every bit depends on every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros behind the end."""
    held = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand.

    Eight bytes at a time go through mix(), which is not linear in them: unlike sums of powers
    modulo 2**64 there is no family of texts that is known to collide.
    """
    size = (end - start).astype(np.int64)
    out = mix(size.astype(_U) * _U(_ODD) + _U(1))
    eight, at = eights(data), 0
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    while len(live):
        left = size[live] - at
        part = eight[start[live] + at]
        part &= ~_U(0) >> (_U(64) - _U(8) * np.minimum(left, 8).astype(_U))
        out[live] = mix(out[live] ^ part)
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Windows:
    """Hashes of spans of at least 32 bytes of one byte string, from its 32-byte windows; not linear either."""

    STEP = 32

    def __init__(self, data: np.ndarray, seed: int = 0) -> None:
        level, width = mix(eights(data)[: max(0, len(data) - 7)] ^ mix(np.full(1, seed + 1, _U))), 8
        while width < self.STEP:
            level = mix(level[:-width] * _U(_ODD) + level[width:]) if len(level) > width else level[:0]
            width *= 2
        self.n, self.level = len(data), level

    def everywhere(self, width: int) -> np.ndarray:
        """Of the window of `width` bytes (32 to 64) at each place."""
        m = max(0, self.n - width + 1)
        return mix(self.level[:m] * _U(_ODD) + self.level[width - self.STEP : width - self.STEP + m])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of data[start:end]."""
        out = mix((end - start).astype(_U))
        live, at = np.arange(len(start)), 0
        while len(live):
            here = np.minimum(start[live] + at, end[live] - self.STEP)
            out[live] = mix(out[live] * _U(_ODD) + self.level[here])
            at += self.STEP
            live = live[end[live] - start[live] > at]
        return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word `[^\\x20\\x09-\\x0D]+`; a word never crosses rows."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int, weigh=None) -> tuple[np.ndarray, ...]:
    """(row, hash) of the distinct n-word shingles of each row, sorted by both.

    weigh: a function of word hashes; the sum over each shingle's words then comes third.

    A row with fewer than n words but at least one has its whole word sequence as its only shingle.
    """
    start, end, row = words_of(data, offsets)
    if not len(start):
        return (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))[: 2 if weigh is None else 3]
    word = span_hashes(data, start, end)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.concatenate(([0], np.cumsum(counts)))
    place = np.arange(len(word)) - begin[row]
    full = np.flatnonzero(place + n <= counts[row])
    acc = np.full(len(full), n, _U)
    for k in range(n):
        acc = mix(acc * _U(_ODD) + word[full + k])
    weight = weigh(word) if weigh else np.zeros(len(word), np.int64)
    total = np.concatenate(([0], np.cumsum(weight)))
    rows, hashes, sums = [row[full]], [acc], [total[full + n] - total[full]]
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        one = np.full(1, counts[r], _U)
        for k in range(counts[r]):
            one = mix(one * _U(_ODD) + word[begin[r] + k : begin[r] + k + 1])
        rows.append(np.full(1, r))
        hashes.append(one)
        sums.append(total[begin[r] + counts[r]] - total[begin[r] : begin[r] + 1])
    rows, hashes, sums = np.concatenate(rows), np.concatenate(hashes), np.concatenate(sums)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return (rows[keep], hashes[keep]) if weigh is None else (rows[keep], hashes[keep], sums[order][keep])


def lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list column: values grouped by ascending rows."""
    ends = np.searchsorted(rows, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))
