"""Operator 2: removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart only through their first `width` bytes, most significant digit first:

* Digit 1 is a `DIGIT`-byte string. Of a window's suffixes only the one with the least digit hash
  (leftmost on ties) is sorted: equal windows choose it at the same place, so nothing is lost, and
  some 80 times fewer suffixes are sorted. Groups of one drop out here.
* Digit 2 is the whole stretch of all windows that chose this suffix. Where two suffixes agree in
  it, all of these windows repeat.
* Suffixes that agree in digit 1 but not in digit 2 go on, one for all that agree in digit 2. Their
  windows are cut into blocks of BLOCK; the next digit is what all windows of a block share, the
  one after it the block's whole stretch, as before.
* Only where a block agrees in the first of these but not in the second is each single window
  compared through its full `width`: that is at the ends of repeated passages.

Equal groups after the last digit are exactly the strings of `width` bytes that start more than
once. Digits are compared by 64-bit hashes that no known family of texts makes collide; what is cut has agreed
in two of them (digits 1 and 2, or both hashes of a single window). Texts are identified by their
128-bit MD5.

Every group is counted by a pre-aggregated groupBy, the counts are written, and the suffixes are joined
to them: both sides of that join are plain shuffles, so Spark splits the task of a passage that a third
of all texts share. Exact copies of a text are one text throughout. Long texts are read in segments.

Rows: null text counts as empty. A repeated row is a copy like any other, so all its windows
repeat. Texts below `width` bytes lose nothing but still count as rows. Null or repeated doc_ids
don't matter: a row's result depends on its text alone. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Windows, discard, materialize, mix, pieces, small_batches, texts

DIGIT = 40
#: Windows of a block in the second pair of digits.
BLOCK = 16
#: Bytes of text that are hashed at a time; longer texts are read in overlapping segments of this size.
SEGMENT = 512 << 10
_U = np.uint64

_ANCHORS = T.StructType([
    T.StructField("digit", T.LongType()), T.StructField("stretch", T.LongType()), T.StructField("key", T.BinaryType()),
    T.StructField("at", T.LongType()), T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()),
])


def _segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, offsets, place of the first byte in its text); a text over SEGMENT comes alone, in several turns."""
    for rows, data, offsets in pieces(batches, "text", SEGMENT):
        step = SEGMENT if len(data) > 2 * SEGMENT and rows.num_rows == 1 else max(len(data), 1)
        for at in range(0, len(data), step):
            part = data[at : at + step + width - 1] if step < len(data) else data
            yield rows, part, np.array([0, len(part)]) if rows.num_rows == 1 else offsets, at


def _window_minima(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the least of hashes[i : i + span], leftmost on ties."""
    n = len(hashes)
    bits = _U(max(1, int(n).bit_length()))
    keyed = ((hashes >> bits) << bits) | np.arange(n, dtype=_U)
    padded = np.full(-(-n // span) * span, ~_U(0))
    padded[:n] = keyed
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - span + 1], ahead[span - 1 : n])
    return (least & ((_U(1) << bits) - _U(1))).astype(np.int64)


def _anchors(width: int):
    span = width - DIGIT + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies within a task give their anchors once
        for rows, data, offsets, base in _segments(batches, width):
            if len(data) < width:
                continue
            keys = rows.column("key").to_pylist()
            use = np.ones(len(keys), bool)
            if not base:
                for i, key in enumerate(keys):
                    use[i] = key not in seen
                    if len(seen) < 200_000:
                        seen.add(key)
            if not use.any():
                continue
            windows = Windows(data)
            digits = windows.everywhere(DIGIT)
            chosen = _window_minima(digits, span)
            lengths = np.diff(offsets)
            room = np.repeat(offsets[1:], lengths)[: len(chosen)] - np.arange(len(chosen))
            start = np.flatnonzero((room >= width) & np.repeat(use, lengths)[: len(chosen)])
            if not len(start):
                continue
            chosen = chosen[start]
            fresh = np.ones(len(start), bool)
            fresh[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(start)) - 1
            anchor, low, high = chosen[first], start[first], start[last]
            before, after = anchor - low, anchor - high
            stretch = windows.spans(low, high + width) * _U(31) + before.astype(_U)
            row = np.searchsorted(offsets, low, "right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(digits[anchor].view(np.int64)), pa.array(stretch.view(np.int64)), rows.column("key").take(pa.array(row)),
                pa.array(anchor - offsets[row] + base), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)),
            ], schema=_arrow(_ANCHORS))

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BinaryType: pa.binary(), T.StringType: pa.string()}
    return pa.schema([(f.name, kinds[type(f.dataType)]) for f in schema.fields])


_WINDOWS = T.StructType([T.StructField("window", T.LongType()), T.StructField("other", T.LongType()), T.StructField("place", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("at", T.LongType())])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within it) of counts.sum() items."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _todo(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(rows, bytes, row, place in the bytes, place in the text, before, after) of the suffixes to go on with.

    At most SEGMENT bytes of text at a time, with what the suffixes' windows reach on either side.
    """
    for rows, data, offsets in pieces(batches, "text", SEGMENT):
        todo = rows.column("todo")
        flat = todo.flatten()
        row = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(todo.offsets)))
        at, before, after = (np.asarray(flat.field(c)).astype(np.int64) for c in ("at", "before", "after"))
        here = at + offsets[row]
        step = SEGMENT if rows.num_rows == 1 else max(len(data), 1)
        for low in range(0, len(data), step):
            use = np.flatnonzero((here >= low) & (here < low + step))
            if len(use):
                start = max(0, low - width)
                yield rows, data[start : low + step + 2 * width], row[use], here[use] - start, at[use], before[use], after[use]


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, row, here, at, before, after in _todo(batches, width):
            windows = Windows(data)
            for cut in range(0, len(row), 50_000):
                r, h, a, b, f = (x[cut : cut + 50_000] for x in (row, here, at, before, after))
                own, k = _spread(b // BLOCK - f // BLOCK + 1)
                block, base = f[own] // BLOCK + k, h[own]
                low, high = np.maximum(f[own], block * BLOCK), np.minimum(b[own], block * BLOCK + BLOCK - 1)
                shared = windows.spans(base - block * BLOCK, base - block * BLOCK - BLOCK + 1 + width)
                stretch = windows.spans(base - high, base - low + width) * _U(31) + high.astype(_U)
                yield pa.RecordBatch.from_arrays([
                    pa.array((shared * _U(31) + block.astype(_U)).view(np.int64)), pa.array(stretch.view(np.int64)), rows.column("key").take(pa.array(r[own])),
                    pa.array(a[own]), pa.array(high.astype(np.int32)), pa.array(low.astype(np.int32)),
                ], schema=_arrow(_ANCHORS))

    return run


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, row, here, at, before, after in _todo(batches, width):
            one, two = Windows(data), Windows(data, seed=1)
            names = np.array([int.from_bytes(k[:8], "little") for k in rows.column("key").to_pylist()], _U)
            for cut in range(0, len(row), 20_000):
                r, h, a, b, f = (x[cut : cut + 20_000] for x in (row, here, at, before, after))
                own, k = _spread(b - f + 1)
                start, low = a[own] - b[own] + k, h[own] - b[own] + k
                place = mix(names[r[own]] ^ mix(start.astype(_U)))
                hashes = [pa.array(w.spans(low, low + width).view(np.int64)) for w in (one, two)]
                yield pa.RecordBatch.from_arrays([*hashes, pa.array(place.view(np.int64)), rows.column("key").take(pa.array(r[own])), pa.array(start)], schema=_arrow(_WINDOWS))

    return run


def _refine(suffixes: DataFrame, width: int, tag: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(key, low, high) of what repeats as a whole, and by key the suffixes to go on with.

    suffixes: a written table of _ANCHORS, perhaps with copies of rows; it is discarded. Groups of one digit drop out unless another suffix shares it.
    """
    again = materialize(suffixes.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit"), tag + "-digits")
    kept = materialize(suffixes.join(again, "digit").dropDuplicates(["key", "at", "before", "after"]), tag)
    discard(suffixes, again)
    one = F.min(F.struct("key", "at", "before", "after")).alias("one")
    groups = materialize(kept.groupBy("digit", "stretch").agg(F.count(F.lit(1)).alias("n"), one), tag + "-groups")
    whole = kept.join(groups.where("n > 1").select("digit", "stretch"), ["digit", "stretch"])
    whole = whole.select("key", (F.col("at") - F.col("before")).alias("low"), (F.col("at") - F.col("after") + width).alias("high"))
    mixed = materialize(groups.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit"), tag + "-mixed")
    todo = groups.join(mixed, "digit").select("one.*").distinct()
    todo = materialize(todo.groupBy("key").agg(F.collect_list(F.struct("at", "before", "after")).alias("todo")), tag + "-todo")
    discard(mixed)
    return whole, todo, [kept, groups, todo]


def repeated_spans(texts: DataFrame, width: int = 200) -> tuple[DataFrame, list[DataFrame]]:
    """(key, spans) of texts with repeated strings, and the tables to discard afterwards.

    width: at least DIGIT + BLOCK. texts: key (binary, one for each text) and text. spans: array of (low, high), each a stretch of
    repeated bytes; they may overlap and are in no order.
    """
    texts = texts.where(F.octet_length("text") >= width)
    first, todo, used = _refine(materialize(texts.select("key", "text").mapInArrow(_anchors(width), _ANCHORS), "all"), width, "suffixes")
    blocks = materialize(texts.join(todo, "key").select("key", "text", "todo").mapInArrow(_blocks(width), _ANCHORS), "split")
    second, todo, more = _refine(blocks, width, "blocks")
    windows = materialize(texts.join(todo, "key").select("key", "text", "todo").mapInArrow(_windows(width), _WINDOWS), "windows")
    twice = windows.groupBy("window", "other").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("window", "other")
    twice = materialize(twice, "twice")
    single = windows.join(twice, ["window", "other"]).select("key", F.col("at").alias("low"), (F.col("at") + width).alias("high"))
    spans = first.unionByName(second).unionByName(single).distinct().groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return spans, [*used, *more, windows, twice]


def _covered(spans, size: int) -> list[tuple[int, int]]:
    """Merged and sorted."""
    if spans is None or not len(spans):
        return []
    low = np.asarray(spans.values.field("low")) if isinstance(spans, pa.ListScalar) else np.asarray([s[0] for s in spans])
    high = np.asarray(spans.values.field("high")) if isinstance(spans, pa.ListScalar) else np.asarray([s[1] for s in spans])
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.minimum(np.maximum.accumulate(high[order]), size)
    fresh = np.ones(len(low), bool)
    fresh[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(fresh)
    return list(zip(low[first].tolist(), high[np.append(first[1:], len(low)) - 1].tolist(), strict=True))


_ADDED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _cut(keep: list[T.StructField], as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "_text", SEGMENT):
            copies, spans = rows.column("_copies").to_pylist(), rows.column("_spans")
            out: list[list] = [[], [], [], [], []]
            for i in range(rows.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                cuts = [(0, len(text))] if copies[i] else _covered(spans[i] if spans[i].is_valid else None, len(text))
                stay, at = [], 0
                for low, high in cuts:
                    stay.append(text[at:low].tobytes())
                    at = high
                left = b"".join([*stay, text[at:].tobytes()])
                for column, value in zip(out, (len(text), len(text) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if as_text else None), strict=True):
                    column.append(value)
            columns = [rows.column(f.name) for f in keep] + [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
            if as_text:
                columns.append(pa.array(out[4], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in keep] + _ADDED.names + ["kept_text"] * as_text)

    return run


def remove_repeats(df: DataFrame, text: str = "text", width: int = 200, keep: list[str] | None = None, as_text: bool = True) -> DataFrame:
    """Every row of df with n_bytes, n_removed, n_spans, kept_sha256 and, as_text, kept_text.

    kept_text leaves out single bytes of a character that was cut in two. keep: columns to carry;
    all by default. Input columns with the added names are replaced.
    """
    small_batches(df.sparkSession)
    names = {*_ADDED.names, "kept_text", "_text", "_key", "_copies", "_spans"}
    fields = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    rows = df.select(*[F.col(f"`{f.name}`") for f in fields], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")).withColumn("_key", F.unhex(F.md5("_text")))
    texts = rows.select(F.col("_key").alias("key"), F.col("_text").alias("text"))
    spans, used = repeated_spans(texts, width)
    copies = rows.where(F.octet_length("_text") >= width).groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key", F.lit(True).alias("_copies"))
    marks = copies.join(spans.select(F.col("key").alias("_key"), F.col("spans").alias("_spans")), "_key", "full_outer")
    marks = materialize(marks.select("_key", F.coalesce("_copies", F.lit(False)).alias("_copies"), F.when(F.col("_copies").isNull(), F.col("_spans")).alias("_spans")), "marks")
    discard(*used)
    joined = rows.join(marks, "_key", "left").drop("_key").withColumn("_copies", F.coalesce("_copies", F.lit(False)))
    schema = T.StructType(fields + _ADDED.fields + ([T.StructField("kept_text", T.StringType())] if as_text else []))
    return joined.mapInArrow(_cut(fields, as_text), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(texts(spark, sf_dir, "doc_id", "text"), width=200, keep=["doc_id"], as_text=False)


OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, n - 199)) AS s FROM d WHERE n >= 200),
w AS (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, 400)) AS h FROM p),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER v + 200 THEN 0 ELSE 1 END AS new FROM r WINDOW v AS (PARTITION BY doc_id ORDER BY s)),
k AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
b AS (SELECT doc_id, run, min(s) AS low, max(s) + 200 AS high FROM k GROUP BY 1, 2),
t AS (SELECT doc_id, low, high, coalesce(lag(high) OVER v, 0) AS before FROM b WINDOW v AS (PARTITION BY doc_id ORDER BY low)),
c AS (SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans, max(high) AS last, string_agg(substr(x, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept FROM t JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""
