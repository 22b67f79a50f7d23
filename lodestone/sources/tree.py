"""Folders of a mounted file system as Spark sources: a scan that prunes, and a stream of changes.

The scan's partitions are subtrees: the driver opens folders breadth first only until there are enough of them (64, or the
option `splits`), tasks walk the rest. Ignored and linked folders are counted and not entered; files are known by lstat alone,
so no byte of any is read. read_tree() then reads those that are queued, on the executors.

The stream's offsets number snapshots (path, size, time in nanoseconds of every queued file), which lie in a folder of their own
beside the checkpoint. A batch is the difference of two snapshots, dealt to tasks by path: whatever fails or is repeated, the same
two snapshots give the same changes. Snapshots are taken by the driver's Python process, as a watcher's would be; one is
removed once a later one is committed.

Rows: a file that vanishes or can't be looked at is an `error`, as is a name that isn't UTF-8 (its bytes shown as `?`). An empty or
unreadable folder gives nothing; a root that doesn't exist fails.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestone.functions import paths as px
from lodestone.session import ship

FOUND = "path string, size_bytes long, mtime_ns long, outcome string"
CHANGED = "path string, change string, ts timestamp, size_bytes long, mtime_ns long, seen boolean"


class Walker:
    """What of a root is looked at; see paths.ignored() for the rules."""

    def __init__(self, options: dict[str, str]) -> None:
        self.top = os.path.realpath(options["path"].removeprefix("file://"))
        if not os.path.isdir(self.top):
            raise FileNotFoundError(self.top)
        self.most = int(options.get("max_bytes", px.MAX_FILE_BYTES))
        own = os.path.join(self.top, ".knowledgeignore")
        lines = open(own, encoding="utf-8").read().splitlines() if os.path.isfile(own) else []  # noqa: SIM115
        extra = [x.rstrip() for x in lines if x.strip() and not x.lstrip().startswith("#")] + json.loads(options.get("exclude", "[]"))
        self.rules = [(False, re.compile(px.ignore_regex()))] + [(p.startswith("!"), re.compile(px.glob_regex(p.removeprefix("!")))) for p in extra]

    def ignored(self, path: str) -> bool:
        """The last rule that matches decides."""
        path = path.replace("\\", "/")
        return next((not back for back, rule in reversed(self.rules) if rule.search(path)), False)

    def folder(self, below: str) -> tuple[list[tuple], list[str]]:
        """(rows, folders to enter) of one folder, both with paths from the root."""
        rows, deeper = [], []
        try:
            found = sorted(os.scandir(os.path.join(self.top, below)), key=lambda e: e.name)
        except OSError:
            return [], []
        for entry in found:
            path = f"{below}{entry.name}"
            try:
                if entry.is_dir(follow_symlinks=False) or entry.is_symlink() and entry.is_dir():
                    if entry.is_symlink() or self.ignored(path + "/"):
                        rows.append((path + "/", 0, 0, "ignored_directory"))
                    else:
                        deeper.append(path + "/")
                    continue
                path.encode()
                if entry.is_symlink() or self.ignored(path):
                    rows.append((path, 0, 0, "ignored"))
                    continue
                kind, stat = "unsupported", entry.stat(follow_symlinks=False)
                if os.path.splitext(entry.name)[1].lower() in px.SUPPORTED:
                    kind = "ignored" if stat.st_size > self.most else "queued"
                rows.append((path, stat.st_size, stat.st_mtime_ns, kind))
            except (OSError, ValueError):
                rows.append((path.encode("utf-8", "replace").decode(), 0, 0, "error"))
        return rows, deeper

    def below(self, begin: str = "") -> Iterator[tuple]:
        todo = [begin]
        while todo:
            rows, deeper = self.folder(todo.pop())
            yield from rows
            todo += reversed(deeper)


@dataclass
class Subtree(InputPartition):
    """A folder and all below, or (whole false) just the rows that planning has found."""

    begin: str
    whole: bool = True


@dataclass
class Difference(InputPartition):
    """A share of the paths in two snapshots."""

    start: int
    end: int
    share: int
    shares: int


class TreeSource(DataSource):
    """spark.read.format("lodestone_tree"): path, exclude (a JSON list of patterns), max_bytes, splits, snapshots (streams)."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_tree"

    def schema(self) -> str:
        return CHANGED if "snapshots" in self.options else FOUND

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def streamReader(self, schema) -> TreeChanges:
        return TreeChanges(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Subtree]:
        walker, splits = Walker(self.options), int(self.options.get("splits", 64))
        opened, open_ = [], [""]
        while open_ and len(open_) < splits:
            begin = open_.pop(0)
            opened.append(begin)
            open_ += walker.folder(begin)[1]
        return [*[Subtree(b, False) for b in opened], *map(Subtree, open_)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        walker = Walker(self.options)
        yield from walker.below(partition.begin) if partition.whole else walker.folder(partition.begin)[0]


class TreeChanges(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.folder = options, options["snapshots"].removeprefix("file://")

    def _place(self, number: int) -> str:
        return os.path.join(self.folder, f"{number:012d}.parquet")

    def _numbers(self) -> list[int]:
        os.makedirs(self.folder, exist_ok=True)
        return sorted(int(n.split(".")[0]) for n in os.listdir(self.folder) if n.endswith(".parquet"))

    def _snapshot(self, number: int) -> tuple[dict[str, tuple[int, int]], int]:
        if not number:
            return {}, 0
        table = pq.read_table(self._place(number))
        paths, sizes, times = (table.column(c).to_pylist() for c in ("path", "size_bytes", "mtime_ns"))
        return dict(zip(paths, zip(sizes, times, strict=True), strict=True)), int(table.schema.metadata[b"taken_us"])

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        """The number of the latest snapshot; a new one where the tree isn't as that has it."""
        last = max(self._numbers(), default=0)
        now = {p: (s, t) for p, s, t, kind in Walker(self.options).below() if kind == "queued"}
        if now != self._snapshot(last)[0]:
            last += 1
            rows = sorted((p, s, t) for p, (s, t) in now.items())
            table = pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate({"path": pa.string(), "size_bytes": pa.int64(), "mtime_ns": pa.int64()}.items())})
            temporary = os.path.join(self.folder, uuid.uuid4().hex)
            pq.write_table(table.replace_schema_metadata({"taken_us": str(time.time_ns() // 1000)}), temporary, compression="zstd")
            os.rename(temporary, self._place(last))
        return {"snapshot": last}

    def partitions(self, start: dict, end: dict) -> list[Difference]:
        shares = int(self.options.get("splits", 8))
        return [Difference(start["snapshot"], end["snapshot"], i, shares) for i in range(shares)]

    def read(self, partition: Difference) -> Iterator[tuple]:
        import datetime as dt
        import zlib

        before, (after, taken) = self._snapshot(partition.start)[0], self._snapshot(partition.end)
        ts = dt.datetime.fromtimestamp(taken / 1e6, dt.UTC)
        for path in sorted(before.keys() | after.keys()):
            if zlib.crc32(path.encode()) % partition.shares != partition.share or before.get(path) == after.get(path):
                continue
            if path in after:
                yield path, "modified" if path in before else "created", ts, *after[path], True
            else:
                yield path, "deleted", ts, None, None, False

    def commit(self, end: dict) -> None:
        for number in self._numbers():
            if number < end["snapshot"]:
                os.remove(self._place(number))


def _options(root: str, exclude: list[str] | None, max_bytes: int, **more) -> dict[str, str]:
    return {"path": root, "exclude": json.dumps(exclude or []), "max_bytes": str(max_bytes), **{k: str(v) for k, v in more.items() if v is not None}}


def tree(spark: SparkSession, root: str, exclude: list[str] | None = None, max_bytes: int = px.MAX_FILE_BYTES, splits: int | None = None) -> DataFrame:
    """(path, size_bytes, mtime_ns, outcome) of a root's files and its ignored folders."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("lodestone_tree").options(**_options(root, exclude, max_bytes, splits=splits)).load()


def manifest(spark: SparkSession, root_id: str, root: str, exclude: list[str] | None = None, max_bytes: int = px.MAX_FILE_BYTES) -> DataFrame:
    """tree() with root_id and, for queued files, the idempotency key."""
    key = px.idempotency_key(F.lit(root_id), F.col("path"), F.col("size_bytes"), F.col("mtime_ns"))
    return tree(spark, root, exclude, max_bytes).select(F.lit(root_id).alias("root_id"), "path", "size_bytes", "mtime_ns", "outcome", F.when(F.col("outcome") == "queued", key).alias("idempotency_key"))


def read_tree(found: DataFrame, root: str) -> DataFrame:
    """(path, size_bytes, mtime_ns, text, content_hash, problem) of tree()'s queued files; text is null where there is a problem."""
    top = os.path.realpath(root.removeprefix("file://"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "content", "problem"]
        for batch in batches:
            for i in range(batch.num_rows):  # a file a batch: each may have ten million bytes
                path, content, problem = batch.column("path")[i].as_py(), None, None
                try:
                    with open(px.contained(os.path.join(top, path), top), "rb") as f:
                        content = f.read()
                    problem = "binary" if b"\0" in content[: px.BINARY_PROBE] else None
                except (OSError, px.UnsafePath):
                    problem = "unreadable"
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 1) for c in ("size_bytes", "mtime_ns")], pa.array([path]), pa.array([content], pa.binary()), pa.array([problem], pa.string())], names=["size_bytes", "mtime_ns", *names])

    rows = found.where(F.col("outcome") == "queued").select("path", "size_bytes", "mtime_ns").mapInArrow(run, "size_bytes long, mtime_ns long, path string, content binary, problem string")
    rows = rows.withColumn("problem", F.coalesce("problem", F.when(~F.is_valid_utf8("content"), "not UTF-8")))
    good = F.col("problem").isNull()
    return rows.select("path", "size_bytes", "mtime_ns", F.when(good, F.decode("content", "UTF-8")).alias("text"), F.when(good, F.sha2("content", 256)).alias("content_hash"), "problem")


def watch(spark: SparkSession, root: str, snapshots: str, exclude: list[str] | None = None, max_bytes: int = px.MAX_FILE_BYTES) -> DataFrame:
    """Changes of a root's queued files, as streaming.changes takes them. snapshots: a folder that all executors share."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("lodestone_tree").options(**_options(root, exclude, max_bytes, snapshots=snapshots)).load()
