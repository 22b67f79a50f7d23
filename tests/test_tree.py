"""Folders as sources: pruned scans and streams of changes."""

import os

from lodestone.sources import files as fl
from lodestone.sources import tree as tr


def put(root, name, body=b"x"):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_bytes(body)


def test_scan_of_a_tree(spark, tmp_path):
    root = tmp_path / "root"
    for name, body in {
        "a.md": b"# A", "b.exe": b"x", "node_modules/c.js": b"x", "node_modules/deep/d.js": b"x", "sub/d.py": b"def f(): pass", "sub/deep/er/e.TXT": b"e", "bin.txt": b"a\0b", "bad.txt": b"\xff",
        "big.md": b"y" * 200, "build/keep.md": b"k", "out/x.log": b"l", "out/y.log": b"m", ".knowledgeignore": b"# rules\n\n*.log\n!y.log\n!build/keep.md\nprivate/\n", "private/p.md": b"p", "empty.md": b"",
    }.items():
        put(root, name, body)
    os.symlink(root / "a.md", root / "link.md")
    os.symlink(root / "sub", root / "linked")
    os.symlink(root / "gone", root / "broken.md")
    open(os.fsencode(root) + b"/\xff\xfe.md", "wb").close()
    os.chmod(root / "node_modules/c.js", 0)
    for splits in (1, 3, 64):
        found = tr.tree(spark, f"file://{root}", max_bytes=100, splits=splits)
        rows = {r["path"]: r for r in found.collect()}
        assert {p: r["outcome"] for p, r in rows.items()} == {
            "a.md": "queued", "b.exe": "unsupported", "node_modules/": "ignored_directory", "sub/d.py": "queued", "sub/deep/er/e.TXT": "queued", "bin.txt": "queued", "bad.txt": "queued", "empty.md": "queued",
            "big.md": "ignored", "build/": "ignored_directory", "out/x.log": "ignored", "out/y.log": "queued", ".knowledgeignore": "unsupported", "private/": "ignored_directory",
            "link.md": "ignored", "linked/": "ignored_directory", "broken.md": "ignored", "??.md": "error",
        }, splits
        assert fl.scan_stats(found).first().asDict() == {"visited": 14, "queued": 7, "ignored": 8, "unsupported": 2, "errors": 1}
    assert rows["a.md"]["mtime_ns"] == os.lstat(root / "a.md").st_mtime_ns and rows["a.md"]["size_bytes"] == 3
    assert tr.tree(spark, str(root), splits=3).rdd.getNumPartitions() > 3
    texts = {r["path"]: (r["text"], r["problem"]) for r in tr.read_tree(found, str(root)).collect()}
    assert texts == {"a.md": ("# A", None), "sub/d.py": ("def f(): pass", None), "sub/deep/er/e.TXT": ("e", None), "out/y.log": ("m", None), "empty.md": ("", None), "bin.txt": (None, "binary"), "bad.txt": (None, "not UTF-8")}
    (tmp_path / "none").mkdir()
    assert tr.tree(spark, str(tmp_path / "none")).count() == 0
    import pytest

    with pytest.raises(Exception, match="FileNotFoundError"):
        tr.tree(spark, str(tmp_path / "missing")).count()


def test_changes_come_once(spark, tmp_path):
    root, out, check = tmp_path / "root", str(tmp_path / "out"), str(tmp_path / "check")

    def turn():
        """A run from the checkpoint, as after a restart; what it adds."""
        before = spark.read.schema(tr.CHANGED).parquet(out).count() if os.path.isdir(out) else 0
        changes = tr.watch(spark, str(root), str(tmp_path / "snapshots"))
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out).orderBy("ts").collect()[before:]
        return sorted((r["path"], r["change"], r["size_bytes"], r["seen"]) for r in rows)

    for name in ("a.md", "sub/b.py", "node_modules/c.js", "d.exe"):
        put(root, name)
    assert turn() == [("a.md", "created", 1, True), ("sub/b.py", "created", 1, True)]
    assert turn() == []
    put(root, "a.md", b"longer")
    put(root, "e.txt")
    os.remove(root / "sub/b.py")
    assert turn() == [("a.md", "modified", 6, True), ("e.txt", "created", 1, True), ("sub/b.py", "deleted", None, False)]
    assert turn() == []
    put(root, "sub/b.py")  # what was deleted comes back
    os.utime(root / "e.txt", ns=(5, 5))
    assert turn() == [("e.txt", "modified", 1, True), ("sub/b.py", "created", 1, True)]
    assert len(os.listdir(tmp_path / "snapshots")) <= 2
