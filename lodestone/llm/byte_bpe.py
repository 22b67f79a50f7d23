"""Operator 9: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a doubly linked list of byte spans. A pair of neighbours whose joined bytes are
in the vocabulary waits in the bucket of its merge rank. Occupied buckets are bits of a bitmap with
a summary level above it, so the lowest rank is found by find-first-set at each level, in constant
time whatever the pre-token's length. A bucket holds list positions, leftmost first; an entry whose
spans have changed since is stale and skipped when met. A pre-token of n bytes takes O(n log n).

Rows: null text counts as empty and gives no ids. Rows are independent: repeated rows and ties give
equal results, other columns are untouched, an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import pieces, small_batches, texts

#: Ranks of one bitmap leaf, as a power of two: with some 50,000 ranks both levels have a few hundred bits.
LEAF_BITS = 8
LEAF_MASK = (1 << LEAF_BITS) - 1
#: Entries of one half of each of a worker's two caches of encoded strings.
CACHE_ENTRIES = 450_000
#: Strings longer than this are not cached.
CACHE_CHARS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Generations:
    """A bounded cache: when the newer half is full it becomes the older half, and what is still met moves back."""

    def __init__(self, entries: int) -> None:
        self.entries, self.new, self.old = entries, {}, {}

    def older(self, key):
        """The older half's value of a key that the newer half lacks, or None."""
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.entries:
            self.old, self.new = self.new, {}
        self.new[key] = value


class ByteBPE:
    """Encodes with given ranks and pre-token pattern; special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = CACHE_ENTRIES) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.pattern = pattern
        self.tokens = {v: k for k, v in ranks.items()}
        self.n_leaves = (max(ranks.values(), default=0) >> LEAF_BITS) + 1
        self.words, self.pre = Generations(entries), Generations(entries)

    def merge(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of each of some pre-tokens, merged in one queue.

        The queue: `buckets` by rank; `leaves`, each a bitmap of 2**LEAF_BITS ranks; `top`, a
        bitmap of the leaves that aren't empty. pair[i] is the rank of the span that starts at i
        joined with its right neighbour; a queued position whose pair no longer has its bucket's
        rank is stale. Pre-tokens lie one behind the other and never merge across an edge, so
        serving many at once changes no result: within each, the lowest rank goes first, and its
        leftmost pair.
        """
        get, data = self.ranks.get, b"".join(tokens)
        n, leaves, buckets, top = len(data), [0] * self.n_leaves, {}, 0
        end, before, pair, edge = list(range(1, n + 1)), list(range(-1, n)), [-1] * n, bytearray(n + 1)
        at = 0
        for token in tokens:
            edge[at] = 1
            at += len(token)
        edge[n] = 1
        for i in range(n - 1):
            if not edge[i + 1] and (rank := get(data[i : i + 2])) is not None:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
        for rank in buckets:
            leaves[rank >> LEAF_BITS] |= 1 << (rank & LEAF_MASK)
            top |= 1 << (rank >> LEAF_BITS)
        while top:
            leaf = (top & -top).bit_length() - 1
            bits = leaves[leaf]
            low = bits & -bits
            now = (leaf << LEAF_BITS) + low.bit_length() - 1
            leaves[leaf] = bits = bits ^ low
            if not bits:
                top &= top - 1
            bucket = buckets.pop(now)
            bucket.sort()
            for k, i in enumerate(bucket):
                if pair[i] != now:
                    continue
                middle = end[i]
                end[i] = stop = end[middle]
                pair[middle] = -1
                lowest = now + 1
                if edge[stop]:
                    pair[i] = -1
                else:
                    before[stop] = i
                    rank = get(data[i : end[stop]])
                    if rank is None:
                        pair[i] = -1
                    else:
                        pair[i] = lowest = rank
                        if rank in buckets:
                            buckets[rank].append(i)
                        else:
                            buckets[rank] = [i]
                            leaves[rank >> LEAF_BITS] |= 1 << (rank & LEAF_MASK)
                            top |= 1 << (rank >> LEAF_BITS)
                if not edge[i]:
                    left = before[i]
                    rank = get(data[left:stop])
                    if rank is None:
                        pair[left] = -1
                    else:
                        pair[left] = rank
                        if rank < lowest:
                            lowest = rank
                        if rank in buckets:
                            buckets[rank].append(left)
                        else:
                            buckets[rank] = [left]
                            leaves[rank >> LEAF_BITS] |= 1 << (rank & LEAF_MASK)
                            top |= 1 << (rank >> LEAF_BITS)
                if lowest <= now:  # what has come goes before the rest of this bucket, or among it
                    rest = bucket[k + 1 :]
                    if now in buckets:
                        buckets[now] += rest
                    elif rest:
                        buckets[now] = rest
                        leaves[now >> LEAF_BITS] |= 1 << (now & LEAF_MASK)
                        top |= 1 << (now >> LEAF_BITS)
                    break
        out, i = [], 0
        for token in tokens:
            ids, stop = [], i + len(token)
            while i < stop:
                ids.append(get(data[i : end[i]]))
                i = end[i]
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        found = self.encode_many([text])[0][1]
        return [int(x) for x in found.split(",")] if found else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_many(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids joined by commas, the bytes they decode to) of each text."""
        rows, missing, get = [], {}, self.words.new.get
        for text in texts:
            keys = self.keys(text)
            got = list(map(get, keys))
            if None in got:
                for key, value in zip(keys, got, strict=True):
                    if value is None:
                        missing[key] = None
            rows.append((keys, got))
        self._fill(missing)
        out = []
        for keys, got in rows:
            if None in got:
                got = [missing[k] if v is None else v for k, v in zip(keys, got, strict=True)]
            out.append((sum([g[1] for g in got]), ",".join([g[0] for g in got]), b"".join([g[2] for g in got])))
        return out

    def _fill(self, missing: dict) -> None:
        """Encodes what no cache has, all of it in one queue."""
        todo, fresh = {}, {}
        for key in missing:
            missing[key] = self.words.older(key)
            if missing[key] is None:
                todo[key] = tokens = self.find(key[1:] if key[0] == " " else " " + key)
                for token in tokens:
                    if token not in fresh:
                        fresh[token] = self.pre.new.get(token) or self.pre.older(token)
        ask = []
        for token, ids in fresh.items():
            if ids is None:
                raw = token.encode()
                whole = self.ranks.get(raw)
                if whole is None:
                    ask.append((token, raw))
                else:
                    fresh[token] = [whole]
        for (token, _), ids in zip(ask, self.merge([raw for _, raw in ask]), strict=True):
            fresh[token] = ids
            if len(token) <= CACHE_CHARS:
                self.pre.put(token, ids)
        for key, tokens in todo.items():
            ids = fresh[tokens[0]] if len(tokens) == 1 else [x for t in tokens for x in fresh[t]]
            missing[key] = ",".join(map(str, ids)), len(ids), self.decode(ids)
            if len(key) <= CACHE_CHARS:
                self.words.put(key, missing[key])

    @staticmethod
    def keys(text: str) -> list[str]:
        """Consecutive parts of a text, each of which the pattern splits by itself.

        No pre-token holds a single space between two solid characters except as its first
        character, so texts are cut there. Where a part would begin or end with other white space
        it stays with its neighbours. A part that begins with such a space is given without it;
        any other is marked by a space before it.
        """
        if not text:
            return []
        if not _CROWDED.search(text):
            keys = text.split(" ")
            keys[0] = " " + keys[0]
            return keys
        keys, at = [], 0
        for m in _CUT.finditer(text):
            keys.append(" " + text[at : m.start()] if not at else text[at : m.start()])
            at = m.end()
        keys.append(text[at:] if at else " " + text)
        return keys


#: What either of two libraries counts as white space.
_WHITE = "".join(c for c in map(chr, range(0x3100)) if c.isspace() or regex.match(r"\s", c))
_CROWDED = re.compile(f" [{_WHITE}]|[{_WHITE}] |^[{_WHITE}]|[{_WHITE}]$")
_CUT = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")


def encode_decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep_ids: bool = True, entries: int = CACHE_ENTRIES) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) to each row.

    The vocabulary (bounded by the rank file) travels with the function; one pass, no shuffle.
    An input column with one of these names is replaced. entries: of one half of each of a worker's caches, which stay
    with the worker when the job is done; fewer cost time where other jobs want its memory.
    """
    small_batches(df.sparkSession)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        added.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = {f.name for f in added}
    kept = [f for f in df.schema.fields if f.name not in names]
    drop_text = not keep_ids  # the digest form has no use for the text any more
    kept = [f for f in kept if not (drop_text and f.name == text)]
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern, entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(shared)
        for batch, _, _ in pieces(batches, text, 2 << 20):
            counts, ids_sha, decoded_sha, all_ids = [], [], [], []
            for count, joined, decoded in bpe.encode_many([x or "" for x in batch.column(text).to_pylist()]):
                counts.append(count)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    all_ids.append([int(x) for x in joined.split(",")] if joined else [])
            columns = [batch.column(f.name) for f in kept] + [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept + added])

    return df.mapInArrow(run, T.StructType(kept + added))


_WORKER: dict[tuple, ByteBPE] = {}


def _worker(shared) -> ByteBPE:
    """One encoder for each Python worker and vocabulary; its caches outlive a task."""
    if shared.value[1:] not in _WORKER:
        gc.set_threshold(200_000, 50, 1000)  # a million cached tuples would otherwise be walked again and again
        _WORKER.clear()  # one vocabulary's caches at a time
        _WORKER[shared.value[1:]] = ByteBPE(*shared.value)
    return _WORKER[shared.value[1:]]


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = texts(spark, sf_dir, "doc_id", "text")
    return encode_decode(docs, load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
