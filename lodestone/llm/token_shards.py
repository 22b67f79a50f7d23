"""Operator 10: token-ID output in training order.

The token stream of all texts, an end mark after each, is cut into sequences of a fixed length; the
last is padded. A keyed Feistel permutation with cycle-walking gives sequence k its slot: a
bijection on 0 .. N-1 that needs no table and no shuffle of its own, so any slot can be computed,
checked and resumed alone. Slots are cut into shards of a fixed number of rows; rows are
range-partitioned by shard and sorted by slot, and every row has the same stride in bytes, so slot s
is at byte (s mod rows) * stride of shard s div rows. The query writes the shards to a new folder
in the shared one and returns (shard, rows, sha256, path) of each once its file has been read back.

Offsets in the stream need no shuffle: each task counts within its part as it tokenises, the written
parts' totals (one number for each task) are summed on the driver, and the sums are added to the
parts. The tokenised table is written first, so a retried task can't change the order.

Rows: a null text is an empty text and still has its end mark. Null and repeated doc_ids don't
matter; rows keep the order in which the input's partitions give them. An empty table has no
sequence. Very long texts are cut like any other; one that the library's encoder gives up on (its pattern runs out of
stack on about a million spaces) is encoded by operator 9's.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import ByteBPE, load_ranks
from .common import discard, materialize, shared_dir, small_batches, table

SEQUENCE = 1024
SHARD_ROWS = 4096
KEY = 0x5EED_0F_7A1E
ROUNDS = 4
_U = np.uint64


def feistel(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 .. n-1, by value.

    A balanced network on 2 b bits, the fewest that hold n; what falls outside walks on until it
    is inside, which it is within four steps on average.
    """
    x = np.asarray(index, _U).copy()
    if n <= 1:
        return x
    half = _U(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (_U(1) << half) - _U(1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "big") for r in range(ROUNDS)]
    todo = np.arange(len(x))
    while len(todo):
        y = x[todo]
        left, right = y >> half, y & mask
        for k in keys:
            h = (right ^ _U(k)) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(32)
            h *= _U(0xD6E8FEB86659FD93)
            h ^= h >> _U(32)
            left, right = right, left ^ (h & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= _U(n)]
    return x


def tokenise(docs: DataFrame, ranks: dict[bytes, int], pattern: str, end: int) -> DataFrame:
    """(file, first, start, n, ids): each text's ids as little-endian uint16, and its offset within a run of rows.

    docs: text and, from in_file_order(), file and row; a run is then what a task reads of one file without a gap,
    and the stream is the files by name, row by row. Without them a task is a run.
    """
    if end > 0xFFFF or max(ranks.values(), default=0) > 0xFFFF:
        raise ValueError("ids must fit in 16 bits")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    stable = {"file", "row"} <= set(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = _encoder(shared), 0
        file, first, row = "", TaskContext.get().partitionId() << 40, None
        for batch in batches:
            files, firsts, starts, counts, ids = [], [], [], [], []
            places = zip(batch.column("file").to_pylist(), batch.column("row").to_pylist(), strict=True) if stable else itertools.repeat((None, None))
            for text, (f, r) in zip(batch.column("text").to_pylist(), places):
                if stable:
                    if row is None or f != file or r != row + 1:  # the next split of a file begins here
                        file, first, at = f, r, 0
                    row = r
                found = np.array([*encode(text or ""), end], "<u2")
                files.append(file)
                firsts.append(first)
                starts.append(at)
                counts.append(len(found))
                ids.append(found.tobytes())
                at += len(found)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(firsts, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["file", "first", "start", "n", "ids"])

    return docs.select("text", *(["file", "row"] if stable else [])).mapInArrow(run, "file string, first long, start long, n long, ids binary")


def in_file_order(docs: DataFrame) -> DataFrame:
    """(text, file, row) of a scanned Parquet table: with these the stream doesn't depend on how Spark splits files."""
    return docs.select("text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


_ENCODERS: dict[str, object] = {}


def _encoder(shared):
    ranks, pattern = shared.value
    if pattern not in _ENCODERS:
        import tiktoken

        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def encode(text: str) -> list[int]:
            try:
                return fast(text)
            except BaseException as e:
                if type(e).__name__ != "PanicException":  # which is no Exception, and has no name to import
                    raise
                return ByteBPE(ranks, pattern).encode(text)

        _ENCODERS[pattern] = encode
    return _ENCODERS[pattern]


def training_rows(tokens: DataFrame, key: int = KEY, length: int = SEQUENCE, shard_rows: int = SHARD_ROWS, pad: int = 0) -> DataFrame:
    """(slot, shard, row, sequence, n_tokens, ids) of every sequence, partitioned by shard and sorted by slot.

    tokens: a written table of tokenise()'s columns. ids is `length` little-endian uint16.
    """
    spark = tokens.sparkSession
    totals = sorted((r["file"], r["first"], int(r["s"])) for r in tokens.groupBy("file", "first").agg(F.sum("n").alias("s")).collect())  # one row for each file split
    bases, total = [], 0
    for file, first, size in totals:
        bases.append((file, first, total))
        total += size
    n = -(-total // length)
    placed = tokens.join(F.broadcast(spark.createDataFrame(bases, "file string, first long, base long")), ["file", "first"])  # as many rows as file splits
    placed = placed.select((F.col("base") + F.col("start")).alias("at"), "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress  # ids shrink more than the shuffle's own codec makes them
        for batch in batches:
            seq, place, part = [], [], []
            for at, ids in zip(batch.column("at").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                done, size = 0, len(ids) // 2
                while done < size:
                    k, inside = divmod(at + done, length)
                    take = min(length - inside, size - done)
                    seq.append(k)
                    place.append(inside)
                    part.append(pack(ids[2 * done : 2 * (done + take)]))
                    done += take
            seq = np.array(seq, np.int64)
            slot = feistel(seq, n, key).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot // shard_rows), pa.array(slot), pa.array(seq), pa.array(place, pa.int32()), pa.array(part, pa.binary())], names=["shard", "slot", "sequence", "place", "piece"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, unpack = None, [], zstandard.ZstdDecompressor().decompress

        def row() -> tuple:
            ids = b"".join(parts)
            return (held[0], held[0] // shard_rows, held[0] % shard_rows, held[1], len(ids) // 2, ids + np.full(length - len(ids) // 2, pad, "<u2").tobytes())

        kinds = [pa.int64()] * 5 + [pa.binary()]
        names = ["slot", "shard", "row", "sequence", "n_tokens", "ids"]
        for batch in batches:
            out = []
            for slot, seq, piece in zip(*(batch.column(c).to_pylist() for c in ("slot", "sequence", "piece")), strict=True):
                if held is not None and held[0] != slot:
                    out.append(row())
                    parts = []
                held = (slot, seq)
                parts.append(unpack(piece))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([row()[i]], k) for i, k in enumerate(kinds)], names=names)

    pieces = placed.mapInArrow(cut, "shard long, slot long, sequence long, place int, piece binary")
    dealt = pieces.repartitionByRange("shard").sortWithinPartitions("slot", "place")
    return dealt.mapInArrow(join, "slot long, shard long, row long, sequence long, n_tokens long, ids binary")


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Writes training_rows() as raw shards `shard-00000000.bin` in a folder that all executors share.

    Any file system that pyarrow knows by URI. A shard is written under a name of its own and
    renamed when complete, so a lost or repeated task leaves whole shards only. Returns (shard,
    rows, sha256, path) for each; running it writes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        system.create_dir(root, recursive=True)
        now = None

        def close():
            shard, count, digest, temporary, out = now
            out.close()
            path = f"{root}/shard-{shard:08d}.bin"
            system.move(temporary, path)
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([count]), pa.array([digest.hexdigest()]), pa.array([path])], names=["shard", "rows", "sha256", "path"])

        for batch in batches:
            for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if now is not None and now[0] != shard:
                    yield close()
                    now = None
                if now is None:
                    temporary = f"{root}/.{uuid.uuid4().hex}"
                    now = [shard, 0, hashlib.sha256(), temporary, system.open_output_stream(temporary)]
                now[1] += 1
                now[2].update(ids)
                now[4].write(ids)
        if now is not None:
            yield close()

    return rows.select("shard", "ids").mapInArrow(run, "shard long, rows long, sha256 string, path string")


def checked_shards(written: DataFrame, folder: str, length: int = SEQUENCE) -> DataFrame:
    """write_shards()'s rows, each shard's file read back: fails where size or hash is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        for batch in batches:
            for shard, rows, sha256 in zip(*(batch.column(c).to_pylist() for c in ("shard", "rows", "sha256")), strict=True):
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(f"{root}/shard-{shard:08d}.bin") as f:
                    while block := f.read(1 << 20):
                        digest.update(block)
                        size += len(block)
                if size != 2 * length * rows or digest.hexdigest() != sha256:
                    raise ValueError(f"shard {shard} in {folder} isn't what was written")
            yield batch

    return written.mapInArrow(run, written.schema)


def read_slots(folder: str, first: int, count: int, length: int = SEQUENCE, shard_rows: int = SHARD_ROWS) -> np.ndarray:
    """Rows first .. first + count - 1 of the training order, by seeking: what a resumed run reads."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
    out, stride = [], 2 * length
    while count > 0:
        shard, row = divmod(first, shard_rows)
        take = min(count, shard_rows - row)
        with system.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(row * stride)
            out.append(np.frombuffer(f.read(take * stride), "<u2").reshape(-1, length))
        first, count = first + take, count - take
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    docs = in_file_order(table(spark, sf_dir, "documents"))
    tokens = materialize(tokenise(docs, ranks, P.PATTERN, end=50256), "tokens", level=6)
    folder = f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}/shards"
    written = materialize(write_shards(training_rows(tokens, pad=50256), folder), "manifest")
    discard(tokens)
    return checked_shards(written, folder)
