"""The partly rewritten catalog against the whole merge."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog as ct
from lodestone.operators import store as st

SCAN = "root_id string, path string, size_bytes long, modified_at timestamp, content_hash string"
T = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def at(n):
    return F.lit(T[n]).cast("timestamp")


def rows(df):
    return sorted((tuple(r) for r in df.select(*st.DOCUMENT).collect()), key=str)


def folders(catalog):
    fs, place = catalog._file("rows")
    return {(c.getPath().getName(), g.getPath().getName()) for c in fs.listStatus(place) if "=" in c.getPath().getName() for g in fs.listStatus(c.getPath())}


def test_scan_rewrites_its_cells_only(spark, tmp_path):
    frame = lambda found: spark.createDataFrame(found, SCAN)
    first = frame([("r", f"{f}/d{i}.md", i, T[0], f"h{i}") for f in "abcdefg" for i in range(20)] + [("r", "top.txt", 1, T[0], "x"), ("s", "a/d1.md", 1, T[0], "y")])
    none = spark.createDataFrame([], ct.SCHEMA).select(*st.DOCUMENT)
    catalog = ct.Catalog(spark, f"file://{tmp_path}/c", 4)
    assert catalog.documents().count() == 0 and ct.upsert(catalog, first.limit(0), F.lit("root"), at(0)).number == 0
    ct.upsert(catalog, first, F.lit("root"), at(0))
    whole = st.upsert_documents(none, first, F.lit("root"), at(0)).select(*st.DOCUMENT)
    assert rows(catalog.documents()) == rows(whole) and {r["change_type"] for r in catalog.changed().collect()} == {"created"}

    # one folder: a changed, an equal, a new and a doubled path; rows without a path or root name no file
    before, kept = folders(catalog), dict(catalog.state().cells)
    scan = frame([("r", "a/d1.md", 9, T[1], "new"), ("r", "a/d2.md", 2, T[0], "h2"), ("r", "a/n.md", 1, T[0], "old"), ("r", "a/n.md", 3, T[2], "late"), ("r", None, 1, T[0], "z"), (None, "a/q", 1, T[0], "z")])
    state = ct.upsert(catalog, scan, F.lit("root"), at(1))
    once = frame([("r", "a/d1.md", 9, T[1], "new"), ("r", "a/d2.md", 2, T[0], "h2"), ("r", "a/n.md", 3, T[2], "late")])
    whole = st.upsert_documents(whole, once, F.lit("root"), at(1)).select(*st.DOCUMENT)
    assert rows(catalog.documents()) == rows(whole)
    assert len(state.touched) == 1 and len(folders(catalog) - before) == 1
    assert {c for c, g in state.cells if kept[c] != g} == set(state.touched)
    assert {r["path"]: r["change_type"] for r in catalog.changed().where("change_type <> 'untouched'").collect()} == {"a/d1.md": "modified", "a/d2.md": "unchanged", "a/n.md": "created"}

    # deletion and return
    state = ct.delete(catalog, frame([("r", "a/d1.md", 0, T[0], ""), ("r", "none/x", 0, T[0], "")]), at(2))
    whole = st.mark_deleted(whole, frame([("r", "a/d1.md", 0, T[0], "")]), at(2)).select(*st.DOCUMENT)
    assert rows(catalog.documents()) == rows(whole) and [r["path"] for r in catalog.changed().where("change_type = 'deleted'").collect()] == ["a/d1.md"]
    ct.upsert(catalog, frame([("r", "a/d1.md", 9, T[1], "new")]), F.lit("root"), at(3))
    assert [r["change_type"] for r in catalog.changed().where("path = 'a/d1.md' AND root_id = 'r'").collect()] == ["restored"]

    # another session's view of the folder, and old generations
    now = rows(catalog.documents())
    spark.sql(f"DROP TABLE {catalog.table}")
    again = ct.Catalog(spark, catalog.folder, 4)
    assert rows(again.documents()) == now
    assert again.vacuum() > 0 and rows(again.documents()) == now and len(folders(again)) == len(again.state().cells)
    with pytest.raises(Exception, match="(?i)exist"):
        again._commit(again.state())  # a second writer of one state


def test_only_the_scan_is_shuffled(spark, tmp_path):
    scan = spark.createDataFrame([("r", f"f{i % 9}/{i}", i, T[0], "h") for i in range(300)], SCAN)
    catalog = ct.Catalog(spark, f"file://{tmp_path}/c", 4)
    state = ct.upsert(catalog, scan, F.lit("root"), at(0))
    part = scan.where("path LIKE 'f1/%'")
    plan = ct.merged(catalog, state, part, ct._touched(part), F.lit("root"), at(1))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "BroadcastExchange" not in plan
    above = plan[: plan.index("catalog_")].splitlines()  # from the join down to the table's scan
    assert "REPARTITION_BY_NUM" in plan and not any("Exchange" in line and "REPARTITION_BY_NUM" not in line for line in above)
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
