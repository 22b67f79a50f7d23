"""A written catalog of documents of which a scan rewrites a part.

Rows lie in cells, by root and top folder, so that a scan of a folder touches few of them; a cell is dealt to buckets by
path, so that a folder with most of all rows is still many tasks. A change reads the cells that it touches, already dealt
by the join's keys (only the scan is shuffled), and writes them as a new generation beside the old one. A log of small
files names the generation of each cell that counts: a change is one new file, so readers see all of it or nothing, a
lost driver leaves files that nobody reads, and of two writers at once one fails.

Rows: a null root or path names no file, and such rows of a scan are left out. Of a path that a scan has twice the latest
row counts (the greatest hash and size among those of one time). An empty scan changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths as px
from lodestone.operators import store as st

CELLS = 64
KEYS = ["root_id", "path"]
#: What the last change of a row's cell did to it; for versions and events.
CHANGE = ["previous_hash", "previous_version_id", "change_type"]
SCHEMA = ", ".join(
    f"{c} {'bigint' if c == 'size_bytes' else 'timestamp' if c.endswith('_at') else 'string'}" for c in [*st.DOCUMENT, *CHANGE]
)


@dataclass(frozen=True)
class State:
    """The generation of each cell that has rows, and the cells that the last change wrote."""

    number: int = 0
    cells: tuple[tuple[int, str], ...] = ()
    touched: tuple[int, ...] = ()


@dataclass(frozen=True)
class Catalog:
    """buckets: how many tasks share a cell, the same for a catalog's whole life; a bucket of all touched cells is one task."""

    spark: SparkSession
    folder: str
    buckets: int = 16

    @property
    def table(self) -> str:
        """The table's name in this session, made where it isn't known yet."""
        name = f"catalog_{hashlib.sha256(self.folder.encode()).hexdigest()[:20]}"
        if not self.spark.catalog.tableExists(name):
            place = f"{self.folder}/rows".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({SCHEMA}, cell int, gen string) USING parquet PARTITIONED BY (cell, gen) CLUSTERED BY (root_id, path) INTO {self.buckets} BUCKETS LOCATION '{place}'")
            fs, rows = self._file("rows")
            if fs.exists(rows):
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return name

    def _file(self, below: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _logged(self) -> list[str]:
        fs, log = self._file("log")
        return sorted(f.getPath().getName() for f in fs.listStatus(log)) if fs.exists(log) else []

    def state(self, name: str | None = None) -> State:
        names = [name] if name else self._logged()
        if not names:
            return State()
        fs, place = self._file(f"log/{names[-1]}")
        stream = fs.open(place)
        held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return State(held["number"], tuple(map(tuple, held["cells"])), tuple(held["touched"]))

    def _commit(self, state: State) -> State:
        fs, place = self._file(f"log/{state.number:012d}.json")
        out = fs.create(place, False)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        return state

    def rows(self, state: State | None = None, cells: list[int] | None = None) -> DataFrame:
        """The documents (all columns) of a state, or of some of its cells: a filter by partition alone."""
        live = [(c, g) for c, g in (state or self.state()).cells if cells is None or c in cells]
        named = F.concat_ws("/", F.col("cell").cast("string"), "gen").isin([f"{c}/{g}" for c, g in live])
        return self.spark.table(self.table).where(F.col("cell").isin([c for c, _ in live]) & named)

    def documents(self, state: State | None = None) -> DataFrame:
        return self.rows(state).select(*st.DOCUMENT)

    def changed(self, state: State | None = None) -> DataFrame:
        """What the last change made of the cells that it touched, as st.upsert_documents() gives it: read, not computed again."""
        state = state or self.state()
        return self.rows(state, list(state.touched)).select(*st.DOCUMENT, *CHANGE)

    def _put(self, state: State, rows: DataFrame, cells: list[int]) -> State:
        """Writes whole cells as a new generation and makes it the live one."""
        gen = uuid.uuid4().hex
        out = rows.withColumn("cell", cell_of(F.col("root_id"), F.col("path"))).withColumn("gen", F.lit(gen))
        out.select(*st.DOCUMENT, *CHANGE, "cell", "gen").write.insertInto(self.table)
        kept = [(c, g) for c, g in state.cells if c not in cells]
        return self._commit(State(state.number + 1, tuple(sorted([*kept, *[(c, gen) for c in cells]])), tuple(cells)))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes generations that none of the latest `keep` states names; gives their number."""
        needed = {tuple(x) for name in self._logged()[-keep:] for x in self.state(name).cells}
        fs, place = self._file("rows")
        gone = 0
        for cell in fs.listStatus(place) if fs.exists(place) else []:
            for gen in fs.listStatus(cell.getPath()) if cell.isDirectory() and "=" in cell.getPath().getName() else []:
                key = int(cell.getPath().getName().split("=")[1]), gen.getPath().getName().split("=")[1]
                if key not in needed:
                    self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (cell = {key[0]}, gen = '{key[1]}')")
                    fs.delete(gen.getPath(), True)
                    gone += 1
        return gone


def cell_of(root_id: Column, path: Column) -> Column:
    return F.pmod(F.xxhash64(root_id, px.project_key(path, root_id)), F.lit(CELLS)).cast("int")


def _touched(rows: DataFrame) -> list[int]:
    """The cells of rows: at most CELLS numbers, from the keys alone."""
    return sorted(r["c"] for r in rows.select(cell_of(F.col("root_id"), F.col("path")).alias("c")).distinct().collect())


def create(catalog: Catalog, documents: DataFrame) -> State:
    """Writes documents (st.DOCUMENT; one row a root and path) as a catalog's first state."""
    if catalog.state().number:
        raise ValueError("the catalog exists")
    rows = documents.where("root_id IS NOT NULL AND path IS NOT NULL").select(*st.DOCUMENT, *[F.lit(None).cast("string").alias(c) for c in CHANGE])
    return catalog._put(State(), rows.repartition(catalog.buckets, *KEYS), _touched(rows))


def upsert(catalog: Catalog, scan: DataFrame, root_name: Column, now: Column) -> State:
    """st.upsert_documents() on the cells that a scan (root_id, path, size_bytes, modified_at, content_hash) touches.

    The scan is read twice, first its keys alone; give a written one where that is dear.
    """
    scan = scan.where("root_id IS NOT NULL AND path IS NOT NULL")
    cells, state = _touched(scan), catalog.state()
    if not cells:
        return state
    return catalog._put(state, merged(catalog, state, scan, cells, root_name, now), cells)


def merged(catalog: Catalog, state: State, scan: DataFrame, cells: list[int], root_name: Column, now: Column) -> DataFrame:
    """The touched cells after a scan; the catalog's side of the join isn't shuffled."""
    held = ["modified_at", "content_hash", "size_bytes"]
    dealt = scan.select(*KEYS, *held).repartition(catalog.buckets, *KEYS)
    one = dealt.groupBy(*KEYS).agg(F.max(F.struct(*held)).alias("m")).select(*KEYS, "m.*")
    return st.upsert_documents(catalog.rows(state, cells).select(*st.DOCUMENT), one, root_name, now)


def delete(catalog: Catalog, gone: DataFrame, now: Column) -> State:
    """Marks the paths of `gone` (root_id, path) as deleted; rewrites their cells only."""
    gone = gone.select(*KEYS).where("root_id IS NOT NULL AND path IS NOT NULL")
    state = catalog.state()
    cells = sorted(set(_touched(gone)) & {c for c, _ in state.cells})
    if not cells:
        return state
    before = catalog.rows(state, cells).select(*st.DOCUMENT)
    dealt = gone.repartition(catalog.buckets, *KEYS)
    after = st.mark_deleted(before.withColumn("_was", F.col("state")), dealt, now)
    lost = (F.col("_was") != "deleted") & (F.col("state") == "deleted")
    change = {"previous_hash": F.col("content_hash"), "previous_version_id": F.col("version_id"), "change_type": F.when(lost, "deleted").otherwise("untouched")}
    return catalog._put(state, after.withColumns(change), cells)
