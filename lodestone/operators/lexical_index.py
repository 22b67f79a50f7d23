"""Lexical search from written tables that grow with the corpus: posting blocks, names and path trigrams, in segments.

An append writes one segment; what it replaces or removes is listed in a table of its own, which hides older segments'
rows; merging rewrites segments without their hidden rows, from their postings and not from text. A log of small files
names what is live: a change is one new file, so readers see all of it or nothing, and of two writers at once one fails.

A segment deals its chunks to groups of like length, and up to 16 of these to a part. The text is shuffled once, by part; a
task sorts its tokens (numpy) and writes them as blocks to folders of tokens by hash: places are never shuffled. A block is a
token's places in (a piece of) one group, as flat arrays, with the greatest count that a chunk there has; where a token is
in few chunks of a group, it has one block for several groups of a part, as most tokens are rare and a row costs more than its
places. Such a block has its part in place of the group, and the group of each entry. Counts bound cover-density ranks, so a search
reads the heads of its terms' blocks (three numbers each), evaluates the groups with the greatest bounds, and then only those
whose bound reaches the worst of the ranks found so far. Nothing that could be among the best is left out: results equal
search.lexical()'s.

Paths: a table of trigrams with the number of trigrams of their path. Similarity above the cut needs a number of shared
trigrams (T-occurrence) and a length within bounds; containment needs all inner trigrams of the query. Both give few
candidates, which are then compared exactly.

Rows: null content has no tokens but a name; null and empty paths and symbols match nothing but themselves. Chunks with a
null id can't be replaced. An empty table gives a segment without blocks.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.search import searched_text
from lodestone.session import small_batches

BUCKETS = 16
#: Characters of a group, at most (but one chunk at least), and of the text whose blocks a task sorts, about.
GROUP_CHARS, TASK_CHARS = 16 << 20, 64 << 20
#: Chunks of a group, at most about; groups of the first look; so few that all are read at once; groups listed in a filter, at most
#: (more are joined).
GROUP, FIRST, FEW, LISTED = 256, 8, 64, 10_000
#: Bits of a group's number within its length class.
SUB = 32
#: Bits of a group's number within its part, at most; class from whose half on they fall, so that a part has about 32 MB at most.
PART, LONG = 4, 17
#: Tokens that a task sorts at a time, about.
HELD = 3 << 20


#: Read by these, as a segment without tokens has no files to infer them from.
SCHEMAS = {
    "names": "chunk_id {id}, path string, symbol string, group bigint, segment string",
    "grams": "chunk_id {id}, n int, gram string, bucket int, segment string",
    "blocks": "token string, group bigint, n bigint, most int, ids array<{id}>, ends array<int>, places array<int>, groups array<bigint>, bucket int, segment string",
}
#: What the tasks hand over: of each id the places end before `ends`; `groups` of each id where `group` is a part, else empty.
PIECES = "token string, group bigint, n bigint, most int, ids array<{id}>, ends array<int>, places array<int>, groups array<bigint>"


@dataclass(frozen=True)
class State:
    """What is live: segments (name, seq, chunks) in order, tables of removed ids (name, seq), the type of an id, and whether
    compounds are indexed whole beside their parts."""

    number: int
    kind: str = "bigint"
    segments: tuple[tuple[str, int, int], ...] = ()
    removed: tuple[tuple[str, int], ...] = ()
    compounds: bool = False


@dataclass(frozen=True)
class LexicalIndex:
    """compounds: the tokenizer of an index that has no state yet; afterwards its state has it."""

    spark: SparkSession
    folder: str
    compounds: bool = False

    def state(self) -> State:
        fs, folder = _files(self.spark, f"{self.folder}/log")
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        if not names:
            return State(0, compounds=self.compounds)
        stream = fs.open(_files(self.spark, f"{self.folder}/log/{names[-1]}")[1])
        held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return State(held["number"], held["kind"], tuple(map(tuple, held["segments"])), tuple(map(tuple, held["removed"])), held.get("compounds", False))

    def commit(self, state: State) -> None:
        """Makes a state the live one; fails where another writer was first."""
        fs, place = _files(self.spark, f"{self.folder}/log/{state.number:012d}.json")
        out = fs.create(place, False)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()

    def rows(self, table: str, state: State, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows of the live segments, with `segment` and its `seq`; of some buckets only their folders are listed."""
        root = f"{self.folder}/{table}"
        places = [f"{root}/segment={name}" for name, _, _ in state.segments]
        if buckets is not None:
            fs, _ = _files(self.spark, root)
            deeper = [f"{p}/bucket={b}" for p in places for b in buckets]
            places = [p for p in deeper if fs.exists(_files(self.spark, p)[1])] or places[:1]
        seqs = F.create_map(*[F.lit(x) for name, seq, _ in state.segments for x in (name, seq)])
        found = self.spark.read.schema(SCHEMAS[table].format(id=state.kind)).option("basePath", root).parquet(*places)
        return found.withColumn("seq", seqs[F.col("segment")])

    def alive(self, rows: DataFrame, state: State) -> DataFrame:
        """rows (chunk_id, seq, ...) without those that a later change removed."""
        if not state.removed:
            return rows
        gone = None
        for name, seq in state.removed:
            one = self.spark.read.parquet(f"{self.folder}/removed/{name}").select(F.col("chunk_id").alias("gone"), F.lit(seq).alias("since"))
            gone = one if gone is None else gone.unionByName(one)
        return rows.join(gone, (F.col("chunk_id") == F.col("gone")) & (F.col("seq") < F.col("since")), "left_anti")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _known(spark: SparkSession, *columns: Column) -> list:
    """Values of columns of literals: a local relation is evaluated by the driver, without a job."""
    return list(spark.sql("VALUES (1)").select(*columns).first())


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _parts(classes: dict[int, int]) -> dict[int, int]:
    """The number of groups of each length class: a power of two, so that groups of fewer parts are whole ones of more."""
    held = {c: max(1, min(GROUP, GROUP_CHARS >> (c + 1) // 2)) for c in classes}
    return {c: 1 << max(0, math.ceil(math.log2(max(n, 1) / held[c]))) for c, n in classes.items()}


def _grouped(classes: dict[int, int]) -> Column:
    """The group of a chunk (chunk_id, class): its length class, and a part of that by hash."""
    of = _parts(classes)
    parts = F.array(*[F.lit(of.get(c, 1)) for c in range(max(classes, default=0) + 1)])
    return F.col("class") * F.lit(1 << SUB) + F.pmod(F.xxhash64("chunk_id"), F.get(parts, F.col("class").cast("int")))


def _part(group: Column) -> Column:
    """The part of a group, a negative number; a part is its own. Groups of a part follow one another."""
    bits = F.greatest(F.lit(0), F.least(F.lit(PART), F.lit(LONG) - F.shiftright(F.shiftright(group, SUB) + 1, 1))).cast("int")
    return F.when(group < 0, group).otherwise(-1 - F.call_function("shiftright", group, bits))


def _few() -> int:
    """A token in fewer chunks of a group than this shares its block with other groups."""
    return GROUP // 8


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _lists(starts: np.ndarray, total: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, total).astype(np.int32)), values)


def _order(key: np.ndarray) -> np.ndarray:
    """A stable order of numbers; small ones are sorted with their places as one number, which is faster."""
    if len(key) < 1 << 31 and key.max(initial=0) < 1 << 31:
        both = key.astype(np.int64) << 32 | np.arange(len(key))
        both.sort()
        both &= 0xFFFFFFFF
        return both
    return np.argsort(key, kind="stable")


def _pieces(part: np.ndarray, group: np.ndarray, tokens: pa.Array, code: np.ndarray, chunk: np.ndarray, ids: pa.Array, pos: np.ndarray, few: int) -> pa.RecordBatch:
    """Blocks in the order of tokens, of places (code of a token, chunk: its place in part, group and ids; pos).

    The places of a token are in the order of part, group, chunk and pos.
    """
    rank = np.empty(len(tokens), np.int32)
    by = pc.sort_indices(tokens)
    rank[by.to_numpy()] = np.arange(len(tokens))
    code = rank[code]
    order = _order(code)
    code, chunk, pos = code[order], chunk[order], pos[order].astype(np.int32)
    entry = _runs(code, chunk)
    counts = np.diff(np.append(entry, len(code)))
    code, chunk = code[entry], chunk[entry]
    part, group = part[chunk], group[chunk]
    one = _runs(code, group)  # a token in a group
    own = np.diff(np.append(one, len(entry))) >= few
    new = np.zeros(len(one), bool)  # begins a block
    new[:1] = True
    new[1:] = own[1:] | own[:-1] | (code[one][1:] != code[one][:-1]) | (part[one][1:] != part[one][:-1])
    block = one[new]
    single = np.diff(np.append(np.flatnonzero(new), len(one))) == 1
    n = np.diff(np.append(block, len(entry)))
    most = np.maximum.reduceat(counts, block) if len(block) else counts
    start = entry[block]
    shared = np.repeat(~single, n)
    cuts = np.cumsum(np.where(single, 0, n))
    columns = [
        tokens.take(pa.array(by.to_numpy()[code[block]])), pa.array(np.where(single, group[block], part[block])), pa.array(n.astype(np.int64)), pa.array(most.astype(np.int32)),
        _lists(block, len(entry), ids.take(pa.array(chunk))), _lists(block, len(entry), pa.array((entry + counts - np.repeat(start, n)).astype(np.int32))), _lists(start, len(pos), pa.array(pos)),
        pa.ListArray.from_arrays(pa.array(np.append(0, cuts).astype(np.int32)), pa.array(group[shared])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["token", "group", "n", "most", "ids", "ends", "places", "groups"])


def _slices(blocks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Blocks some thousands at a time, as the other side takes them."""
    for at in range(0, len(blocks), 10_000):
        yield blocks.slice(at, 10_000)


def _blocks_of(batches: Iterator[pa.RecordBatch], few: int = GROUP // 8) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (chunk_id, group, toks, perhaps part) in the order of group and chunk_id; what repeats an id is one chunk."""
    held, size = [], 0
    for batch in batches:
        held.append(_coded(batch))
        size += len(held[-1][2])
        if size < HELD:
            continue
        rows = pa.Table.from_batches([h[0] for h in held])
        ids = rows.column("chunk_id").combine_chunks().dictionary_encode(null_encoding="encode")
        last = _runs(rows.column("group").to_numpy(), ids.indices.to_numpy())[-1]  # the last id may go on in the next batch
        yield from _cut(held, last, few)
        held = _rest(held, last)
        size = sum(len(h[2]) for h in held)
    if held:
        yield from _cut(held, sum(len(h[0]) for h in held), few)


def _coded(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]:
    """(rows without tokens, tokens a row, codes of the tokens, distinct tokens): smaller than the tokens."""
    toks = batch.column("toks")
    size = toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = toks.flatten().dictionary_encode()
    return batch.drop_columns(["toks"]), size, words.indices.to_numpy(zero_copy_only=False).astype(np.int32), words.dictionary


def _rest(held: list, last: int) -> list:
    """What is held, from a row on."""
    out = []
    for rows, size, code, words in held:
        if last < len(rows):
            out.append((rows.slice(last), size[last:], code[size[:last].sum() :], words))
        last = max(0, last - len(rows))
    return out


def _cut(held: list, last: int, few: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches([h[0] for h in held]).slice(0, last)
    size = np.concatenate([h[1] for h in held])[:last]
    if not size.sum():
        return
    words = pa.chunked_array([h[3] for h in held], pa.string()).dictionary_encode().combine_chunks()
    number, at, code = words.indices.to_numpy(zero_copy_only=False).astype(np.int32), 0, []
    for h in held:
        code.append(number[at : at + len(h[3])][h[2]])
        at += len(h[3])
    code = np.concatenate(code)[: size.sum()]
    group = rows.column("group").to_numpy()
    part = rows.column("part").to_numpy() if "part" in rows.column_names else group
    names = rows.column("chunk_id").combine_chunks()
    first = _runs(group, names.dictionary_encode(null_encoding="encode").indices.to_numpy())
    chunk = np.repeat(first, np.diff(np.append(first, len(rows)))).astype(np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    pos = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    chunk = chunk[row]
    if len(first) < len(rows):  # repeated ids: their places in order
        order = np.lexsort((pos, chunk))
        code, chunk, pos = code[order], chunk[order], pos[order]
    yield from _slices(_pieces(part, group, words.dictionary, code, chunk, names, pos, few))


def _write_segment(index: LexicalIndex, segment: str, names: DataFrame, blocks: DataFrame, *order: str) -> None:
    """names: chunk_id, path, symbol, group. blocks: PIECES; both whole. order: in which a task has its blocks not yet."""
    names.sortWithinPartitions("group").write.parquet(f"{index.folder}/names/segment={segment}")
    written = index.spark.read.parquet(f"{index.folder}/names/segment={segment}").select("chunk_id", tx.trigrams(F.col("path")).alias("g"))
    grams = written.select("chunk_id", F.size("g").alias("n"), F.explode("g").alias("gram")).withColumn("bucket", bucket_of(F.col("gram")))
    spread = max(1, index.spark.sparkContext.defaultParallelism // 2 // BUCKETS)  # common trigrams go to several tasks
    grams = grams.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(spread)))
    grams.sortWithinPartitions("bucket", "gram", "n").write.partitionBy("bucket").parquet(f"{index.folder}/grams/segment={segment}")
    rows = blocks.withColumn("bucket", bucket_of(F.col("token")))
    rows.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{index.folder}/blocks/segment={segment}")


def postings(blocks: DataFrame, *keep: str, among: str | None = None) -> DataFrame:
    """(keep, chunk_id, places) of each chunk in blocks, or of those in the array `among` of their row."""
    before = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
    group = lambda i: [F.coalesce(F.get("groups", i), F.col("group")).alias("group")] if "group" in keep else []
    entry = lambda c, i: F.struct(c.alias("chunk_id"), F.slice("places", before(i) + 1, F.get("ends", i) - before(i)).alias("places"), *group(i))
    entries = F.transform("ids", entry if among is None else lambda c, i: F.when(F.array_contains(among, c), entry(c, i)))
    out = blocks.select(*keep, F.explode(entries if among is None else F.array_compact(entries)).alias("e"))
    return out.select(*["e.group" if k == "group" else k for k in keep], "e.chunk_id", "e.places")


def _ids(index: LexicalIndex, ids: DataFrame, seq: int) -> tuple[str, int]:
    name = uuid.uuid4().hex
    ids.select(F.col(ids.columns[0]).alias("chunk_id")).where("chunk_id IS NOT NULL").distinct().write.parquet(f"{index.folder}/removed/{name}")
    return name, seq


def append(index: LexicalIndex, chunks: DataFrame, replaces: DataFrame | None = None) -> LexicalIndex:
    """Adds chunks (chunk_id, path, content, symbol, perhaps heading) as a segment, and takes out what they replace.

    replaces: one column of chunk ids of earlier segments. The text is shuffled once, by part, so that a part's tokens
    are sorted where they are.
    """
    state, segment, kind = index.state(), uuid.uuid4().hex, chunks.schema["chunk_id"].dataType.simpleString()
    if state.segments and kind != state.kind:
        raise ValueError(f"chunk_id is {kind}, in this index {state.kind}")
    seq = state.number + 1
    text = searched_text(chunks)
    kept = chunks.select("chunk_id", "path", F.lower("symbol").alias("symbol"), text.alias("t"), F.floor(2 * F.log2(1 + F.coalesce(F.char_length(text), F.lit(0)))).alias("class"))
    classes = {r["class"]: r["count"] for r in kept.groupBy("class").count().collect()}  # at most 64
    kept = kept.withColumn("group", _grouped(classes))
    tasks = max(index.spark.sparkContext.defaultParallelism, -(-sum(n << (c + 1) // 2 for c, n in classes.items()) // TASK_CHARS))
    own = kept.where("t IS NOT NULL").select("chunk_id", _part(F.col("group")).alias("part"), "group", "t").repartition(tasks, "part").sortWithinPartitions("group", "chunk_id")
    small_batches(index.spark)
    few = _few()
    blocks = own.select("chunk_id", "part", "group", tx.tokens_for(state.compounds)(F.col("t")).alias("toks")).mapInArrow(lambda batches: _blocks_of(batches, few), PIECES.format(id=kind))
    _write_segment(index, segment, kept.select("chunk_id", "path", "symbol", "group"), blocks)
    removed = state.removed if replaces is None else (*state.removed, _ids(index, replaces, seq))
    index.commit(State(seq, kind, (*state.segments, (segment, seq, sum(classes.values()))), removed, state.compounds))
    return index


def remove(index: LexicalIndex, ids: DataFrame) -> LexicalIndex:
    """Takes chunks out; their rows stay in their segments, hidden, until these are merged."""
    state = index.state()
    index.commit(State(state.number + 1, state.kind, state.segments, (*state.removed, _ids(index, ids, state.number + 1)), state.compounds))
    return index


def merge(index: LexicalIndex, segments: list[str] | None = None) -> LexicalIndex:
    """Rewrites segments (None: all) as one, without hidden rows and without reading text."""
    state = index.state()
    taken = tuple(s for s in state.segments if segments is None or s[0] in segments)
    rest = tuple(s for s in state.segments if s not in taken)
    if not taken:
        return index
    part = State(state.number, state.kind, taken, state.removed)
    names = index.alive(index.rows("names", part), part).withColumn("class", F.shiftright("group", SUB))
    classes = {r["class"]: r["count"] for r in names.groupBy("class").count().collect()}
    names = names.withColumn("new", _grouped(classes))
    kind, columns, few = PIECES.format(id=state.kind), ["token", "ids", "ends", "places"], _few()
    moved = index.rows("blocks", part).select("segment", _part(F.col("group")).alias("part"), *columns).groupBy("segment", "part")
    named = names.select("segment", _part(F.col("group")).alias("part"), "chunk_id", "new", _part(F.col("new")).alias("to"))
    blocks = moved.cogroup(named.groupBy("segment", "part")).applyInArrow(lambda own, alive: _regrouped(own, alive, few), kind)
    if len(taken) > 1:  # pieces of several segments: one block a token again
        blocks = blocks.withColumn("part", _part(F.col("group"))).groupBy("part").applyInArrow(lambda own: _joined(own, few), kind)
    segment = uuid.uuid4().hex
    _write_segment(index, segment, names.select("chunk_id", "path", "symbol", F.col("new").alias("group")), blocks, "token", "group")
    seq = max(s[1] for s in taken)
    least = min((s[1] for s in rest), default=None)  # what every segment has seen is done with
    removed = tuple(r for r in state.removed if least is not None and r[1] > least)
    index.commit(State(state.number + 1, state.kind, tuple(sorted((*rest, (segment, seq, sum(classes.values()))), key=lambda s: s[1])), removed, state.compounds))
    return index


def _flat(blocks: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, code, ids, entry, pos) of blocks: code and entry for each place, ids for each entry."""
    ids, ends, places = (blocks.column(c).combine_chunks() for c in ("ids", "ends", "places"))
    n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    last = ends.flatten().to_numpy().astype(np.int64)
    before = np.concatenate(([0], last[:-1])) if len(last) else last
    before[np.cumsum(n) - n] = 0
    count = last - before
    words = blocks.column("token").combine_chunks().dictionary_encode()
    code = np.repeat(np.repeat(words.indices.to_numpy().astype(np.int64), n), count)
    return words.dictionary, code, ids.flatten(), np.repeat(np.arange(len(last)), count), places.flatten().to_numpy().astype(np.int64)


def _regrouped(blocks: pa.Table, names: pa.Table, few: int) -> pa.Table:
    """One part's blocks with the chunks that are in names only, dealt to their new groups."""
    tokens, code, ids, entry, pos = _flat(blocks)
    alive = names.column("chunk_id").combine_chunks()
    both = pa.concat_arrays([alive, ids]).dictionary_encode(null_encoding="encode").indices.to_numpy()
    at = np.full(both.max(initial=-1) + 1, -1, np.int64)
    at[both[: len(alive)]] = np.arange(len(alive))
    at = at[both[len(alive) :]]  # where an entry's chunk is named
    kept = np.flatnonzero(at[entry] >= 0)
    part, group = (names.column(c).to_numpy()[at] if len(alive) else at for c in ("to", "new"))
    return pa.Table.from_batches([_ordered(part, group, tokens, code[kept], entry[kept], ids, pos[kept], few)])


def _ordered(part: np.ndarray, group: np.ndarray, tokens: pa.Array, code: np.ndarray, entry: np.ndarray, ids: pa.Array, pos: np.ndarray, few: int) -> pa.RecordBatch:
    """_pieces() of places whose entries are in no order of groups."""
    order = _order(np.unique(group, return_inverse=True)[1].ravel()[entry])
    return _pieces(part, group, tokens, code[order], entry[order], ids, pos[order], few)


def _joined(blocks: pa.Table, few: int) -> pa.Table:
    """One part's pieces as one block a token, or a token and group."""
    tokens, code, ids, entry, pos = _flat(blocks)
    n = blocks.column("n").to_numpy()
    part, group = np.repeat(blocks.column("part").to_numpy(), n), np.repeat(blocks.column("group").to_numpy(), n)
    group[group < 0] = blocks.column("groups").combine_chunks().flatten().to_numpy()
    return pa.Table.from_batches([_ordered(part, group, tokens, code, entry, ids, pos, few)])


def tidy(index: LexicalIndex, fan: int = 8) -> LexicalIndex:
    """Merges segments of like size wherever there are `fan` of them, so that a search meets few segments."""
    while True:
        tiers: dict[int, list[str]] = {}
        for name, _, chunks in index.state().segments:
            tiers.setdefault(int(math.log(max(chunks, 1), fan)), []).append(name)
        full = [names for _, names in sorted(tiers.items()) if len(names) >= fan]
        if not full:
            return index
        merge(index, full[0])


# --- paths ---------------------------------------------------------------------------------------


def path_candidates(index: LexicalIndex, query: str, state: State | None = None) -> DataFrame | None:
    """(segment, chunk_id) of the paths that can be like a query or contain it; None: any may contain it.

    With m trigrams in the query, n in the path and s shared, s / (m + n - s) is at least 3/20 only if s >= 3 (m + n) / 23,
    and so only if 3 m / 20 <= n <= 20 m / 3. A path that contains the query has all inner trigrams of its words.
    """
    state = state or index.state()
    runs = [r for r in re.findall(r"[^\W_]+", query.lower()) if len(r) >= 3]
    inner = sorted({r[i : i + 3] for r in runs for i in range(len(r) - 2)})
    grams = _known(index.spark, tx.trigrams(F.lit(query)))[0]
    if not inner:
        return None
    m, asked = len(grams), sorted({*grams, *inner})
    buckets = sorted(set(_known(index.spark, F.array(*[bucket_of(F.lit(g)) for g in asked]))[0]))
    like = F.col("n").between(-(-3 * m // 20), 20 * m // 3)
    rows = index.rows("grams", state, buckets).where(F.col("gram").isin(asked) & (like | F.col("gram").isin(inner)))
    counted = rows.groupBy("segment", "chunk_id", "n").agg(F.count(F.lit(1)).alias("s"), F.count(F.when(F.col("gram").isin(inner), 1)).alias("within"))
    return counted.where((F.col("s") * 23 >= (F.col("n") + m) * 3) | (F.col("within") == len(inner))).select("segment", "chunk_id")


def _path_columns(rows: DataFrame, query: str) -> DataFrame:
    lowered, like = query.lower(), tx.like_literal(query.lower())
    similarity = tx.similarity(tx.trigrams(F.col("path")), tx.trigrams(F.lit(query)))
    named = F.lower("path").like(f"%{like}%") | (F.coalesce("symbol", F.lit("")) == lowered)
    return rows.withColumns({"path_match": F.lower("path").like(f"{like}%").cast("int"), "similarity": similarity}).withColumn("named", F.coalesce(named, F.lit(False)) | (F.col("similarity").cast("double") > tx.SIMILARITY_CUT))


def named_chunks(index: LexicalIndex, query: str, state: State) -> DataFrame:
    """(segment, seq, group, chunk_id, path, symbol) of live chunks whose path or symbol is what was asked for."""
    names, found = index.rows("names", state), path_candidates(index, query, state)
    rows = names
    if found is not None:
        by_path = names.join(found, ["segment", "chunk_id"], "left_semi")
        rows = by_path.unionByName(names.where(F.col("symbol") == query.lower())).dropDuplicates(["segment", "chunk_id"])
    rows = _path_columns(rows, query).where("named").select("segment", "seq", "group", "chunk_id", "path", "symbol")
    return index.alive(rows, state)


# --- texts ---------------------------------------------------------------------------------------


def bounds(index: LexicalIndex, branches: list[tx.Branch], state: State) -> DataFrame:
    """(segment, group, bound): the most that a chunk of a group can rank, from the heads of its blocks.

    A chunk with counts c of a branch's k terms has at most sum(c) - k + 1 covers, as each ends at a place of its own that
    is not among the first k - 1, and at most k min(c), as each has a place of the rarest term, and around one place there
    are at most k covers (each begins there or at the last place before it of another term).
    """
    asked = list(dict.fromkeys(t for b in branches for t in b.terms))
    most = [F.max(F.when(F.col("token") == t, F.col("most"))).alias(f"_m{i}") for i, t in enumerate(asked)]
    blocks, count = _blocks(index, asked, state), lambda e, i: e - F.coalesce(F.get("ends", i - 1), F.lit(0))
    shared = blocks.where("group < 0").select("segment", "token", F.explode(F.arrays_zip(F.col("groups").alias("group"), F.transform("ends", count).alias("most"))).alias("e"))
    heads = blocks.where("group >= 0").select("segment", "token", "group", "most").unionByName(shared.select("segment", "token", "e.group", "e.most"))
    heads = heads.groupBy("segment", "group").agg(*most)  # a block may be in pieces
    bound = F.lit(0.0)
    for b in branches:
        counts = [F.col(f"_m{asked.index(t)}") for t in b.terms]
        k, total, all_in = len(counts), sum(counts[1:], counts[0]), F.lit(True)
        for c in counts:
            all_in = all_in & c.isNotNull()
        covers = counts[0] if k == 1 else F.least(k * F.least(*counts), total - k + 1)
        bound = bound + F.when(all_in, covers * tx.WEIGHT).otherwise(0.0)
    return heads.select("segment", "group", bound.alias("bound")).where("bound > 0")


def _blocks(index: LexicalIndex, tokens: list[str], state: State) -> DataFrame:
    buckets = sorted(set(_known(index.spark, F.array(*[bucket_of(F.lit(t)) for t in tokens]))[0]))
    return index.rows("blocks", state, buckets).where(F.col("token").isin(tokens))


def _within(rows: DataFrame, groups: list[tuple[str, int]] | DataFrame) -> DataFrame:
    """rows of these groups; a list is a filter that reaches the files."""
    if isinstance(groups, DataFrame):
        return rows.join(groups, ["segment", "group"], "left_semi")
    by: dict[str, list[int]] = {}
    for segment, group in groups:
        by.setdefault(segment, []).append(group)
    test = F.lit(False)
    for segment, own in by.items():
        test = test | ((F.col("segment") == segment) & F.col("group").isin(own))
    return rows.where(test)


def _with_parts(index: LexicalIndex, groups: list[tuple[str, int]] | DataFrame) -> list[tuple[str, int]] | DataFrame:
    """Groups and their parts: what blocks of these groups can have as their group."""
    if isinstance(groups, DataFrame):
        return groups.unionByName(groups.select("segment", _part(F.col("group")).alias("group")))
    if not groups:
        return groups
    parts = _known(index.spark, F.transform(F.array(*[F.lit(g).cast("bigint") for _, g in groups]), _part))[0]
    return sorted({*groups, *[(segment, p) for (segment, _), p in zip(groups, parts)]})


def text_ranks(index: LexicalIndex, branches: list[tx.Branch], state: State, groups: list[tuple[str, int]] | DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(segment, seq, group, chunk_id, lexical_rank) of the live chunks of these groups that match."""
    asked = list(dict.fromkeys(t for b in branches for t in b.terms))
    every = list(dict.fromkeys([*asked, *[w for b in branches for n in b.without for w in n]]))
    blocks = _within(_blocks(index, every, state), _with_parts(index, groups))
    rows = _within(postings(blocks, "segment", "seq", "group", "token"), groups)  # not what shares their blocks
    rows = index.alive(rows, state)
    if allowed is not None:
        rows = rows.join(allowed, "chunk_id", "left_semi")
    keys = ["segment", "seq", "group", "chunk_id"]
    found = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("m"))

    def at(term: str) -> Column:
        return F.try_element_at("m", F.lit(term))

    def has(words: list[str]) -> Column:
        ends = at(words[0])
        for w in words[1:]:  # where the phrase may go on
            ends = F.array_intersect(F.transform(ends, lambda p: p + 1), at(w))
        return F.coalesce(F.size(ends) > 0, F.lit(False))

    hit = F.lit(False)
    for b in branches:
        test = F.lit(True)
        for words in [*[[w] for w in b.words], *b.phrases]:
            test = test & has(words)
        for words in b.without:
            test = test & ~has(words)
        hit = hit | test
    flat = found.where(hit).select(F.struct(*keys).alias("k"), F.explode("m").alias("term", "places")).where(F.col("term").isin(asked)).select("k", "term", F.explode("places").alias("pos"))
    return tx.cover_ranks(flat, "k", [b.terms for b in branches]).select("k.*", F.col("rank").alias("lexical_rank"))


def chosen_groups(index: LexicalIndex, branches: list[tx.Branch], limit: int, state: State, allowed: DataFrame | None = None) -> list[tuple[str, int]] | DataFrame:
    """The groups that can hold one of the best `limit` texts: as a list, or as a table where there are too many."""
    table = bounds(index, branches, state)
    first = [(r["segment"], r["group"]) for r in table.orderBy(F.desc("bound"), "segment", "group").limit(FEW + 1).collect()]
    if len(first) <= FEW:
        return first
    first = first[:FIRST]
    ranks = text_ranks(index, branches, state, first, allowed).select(F.round("lexical_rank", 9).alias("r")).orderBy(F.desc("r")).limit(limit).collect()
    least = ranks[-1]["r"] - 1e-8 if len(ranks) == limit else 0.0
    table = table.where(F.col("bound") >= least).select("segment", "group")
    listed = table.limit(LISTED + 1).collect()
    return [tuple(r) for r in listed] if len(listed) <= LISTED else table


def lexical(index: LexicalIndex, query: str, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """search.lexical() from the index: (chunk_id, path_match, lexical_rank, similarity, lex_rank), best first.

    allowed: one column chunk_id, the only chunks to search (see search.filtered()).
    """
    state = index.state()
    branches = tx.parse_search(query, state.compounds)
    if any(not b.terms for b in branches):
        raise ValueError("a branch of negations only matches nearly every chunk: search without the index")
    order = [F.desc("path_match"), F.round("lexical_rank", 9).desc(), F.desc("similarity"), F.asc("chunk_id")]
    spark = index.spark
    if not state.segments:
        return spark.createDataFrame([], f"chunk_id {state.kind}, path_match int, lexical_rank double, similarity float, lex_rank int")
    named = named_chunks(index, query, state)
    if allowed is not None:
        named = named.join(allowed, "chunk_id", "left_semi")
    rows = named.select("chunk_id", "path", F.lit(None).cast("double").alias("rank"))
    if branches:
        groups = chosen_groups(index, branches, limit, state, allowed)
        beside = named.select("segment", "group").distinct().limit(LISTED + 1).collect()  # a name's rank counts, however low
        if isinstance(groups, DataFrame) or len(beside) > LISTED:
            groups = bounds(index, branches, state).select("segment", "group") if len(beside) > LISTED else groups.unionByName(named.select("segment", "group")).distinct()
        else:
            groups = sorted({*groups, *map(tuple, beside)})
        hits = text_ranks(index, branches, state, groups, allowed)
        paths = _within(index.rows("names", state), groups).select("segment", "chunk_id", "path")
        rows = rows.unionByName(hits.join(paths, ["segment", "chunk_id"]).select("chunk_id", "path", F.col("lexical_rank").alias("rank")))
    rows = rows.groupBy("chunk_id", "path").agg(F.coalesce(F.max("rank"), F.lit(0.0)).alias("lexical_rank")).withColumn("symbol", F.lit(None).cast("string"))
    out = _path_columns(rows, query).select("chunk_id", "path_match", "lexical_rank", "similarity")
    return out.orderBy(*order).limit(limit).withColumn("lex_rank", F.row_number().over(Window.orderBy(*order)))


def fingerprint(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(name, bytes, time) of a table's files: another value once its data have changed."""
    fs, place = _files(spark, path)
    found, open_ = [], [place]
    while open_:
        for f in fs.listStatus(open_.pop()):
            if f.isDirectory():
                open_.append(f.getPath())
            else:
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))
