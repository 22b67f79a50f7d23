"""Nested metadata: the header reader, overlays by path, and a version that keeps both."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import metadata as md
from lodestone.operators import store as st

HEADER = """title: "A: b # c"  # note
tags: [x, 'y z', 3, {a: 1, b: [true, null]}]
author:
  name: Ann
  roles:
  - editor
  - name: admin
    since: 2020-01-02
    at: http://x.org/a#b
empty:
text: |
  one
    two

  three
fold: >-
  a
  b
list:
  - - 1
    - 2
  - x: 1.5
long: this goes
  on here
multi: [a,
  b,
]
"quoted key": it's"""
WANT = {
    "title": "A: b # c", "tags": ["x", "y z", 3, {"a": 1, "b": [True, None]}], "author": {"name": "Ann", "roles": ["editor", {"name": "admin", "since": "2020-01-02", "at": "http://x.org/a#b"}]},
    "empty": None, "text": "one\n  two\n\nthree\n", "fold": "a b", "list": [[1, 2], {"x": 1.5}], "long": "this goes on here", "multi": ["a", "b"], "quoted key": "it's",
}


def written(value, indent=0):
    """Lines of a value that is a non-empty mapping or list."""
    out = []
    for key, v in value.items() if isinstance(value, dict) else ((None, v) for v in value):
        lead = " " * indent + ("-" if key is None else f"{key}:")
        if isinstance(v, (dict, list)) and v:
            out += [lead, *written(v, indent + 2)]
        else:
            out.append(f"{lead} {json.dumps(v)}")
    return out


def made(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.3 or not depth:
        return {f"k{i}": made(rng, depth + 1) for i in range(rng.randint(1, 4))}
    if depth < 4 and kind < 0.5:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([None, True, False, 0, -17, 2.5, "", "a b", "x: y", "# no", "- dash", "[", 'q"q', "null", "é\n", "12"])


def test_reader():
    assert md.parse(HEADER) == WANT
    rng = random.Random(3)
    for _ in range(300):
        value = made(rng)
        assert md.parse("\n".join(written(value))) == value and md.parse(json.dumps(value)) == value
    deep = "\n".join(" " * i + f"k{i}:" for i in range(md.DEPTH + 5))
    for bad in ("a: [1", "- a\n- b", "just text", "a: 1\n  - b\nc", "a: {b: 1]", deep, "a: " + "[" * 5000, "a: b\n c: d\n}"):
        try:
            assert isinstance(md.parse(bad), dict) and bad.startswith("a: b")
        except ValueError:
            pass
    assert md.parse("k: [" + "x, " * 100_000 + "]")["k"] == ["x"] * 100_000


def test_columns_and_a_written_version(spark, tmp_path):
    rows = [("a.md", f"---\n{HEADER}\n---\n# T\n"), ("b.md", "no header"), ("c.md", "---\na: [1\n---\n"), ("d.md", ""), ("e.md", None), ("f.md", "---\n---\nx"), ("g.txt", "---\na: 1\n---\n"), ("h.md", "---\na: {b: 1, c: 2}\n---")]
    texts = spark.createDataFrame([("r", p, len(t or ""), dt.datetime(2024, 1, 1), p, t) for p, t in rows], "root_id string, path string, size_bytes long, modified_at timestamp, content_hash string, text string")
    got = {r["path"]: r["j"] and json.loads(r["j"]) for r in texts.select("path", F.to_json(md.frontmatter(F.col("text"))).alias("j")).collect()}
    assert got == {"a.md": WANT, "b.md": {}, "c.md": None, "d.md": {}, "e.md": None, "f.md": {}, "g.txt": {"a": 1}, "h.md": {"a": {"b": 1, "c": 2}}}

    from lodestone.operators import catalog as ct

    now = F.lit("2024-02-01").cast("timestamp")
    merged = st.upsert_documents(spark.createDataFrame([], ct.SCHEMA).select(*st.DOCUMENT), texts, F.lit("root"), now)
    own = {"pipeline.version": F.lit("p1"), "author.name": F.lit("me"), "a.b": F.lit(7), "title.x": F.lit(None).cast("string")}
    v = st.new_versions(merged, texts, spark.createDataFrame([], "version_id string"), now, own, nested=True)
    st.append(v, f"{tmp_path}/v", 0)
    back = st.stored(spark, f"{tmp_path}/v")
    assert dict(back.dtypes)["metadata"] == "variant"
    got = {r["path"]: json.loads(r["j"]) for r in back.select("path", F.to_json("metadata").alias("j")).collect()}
    laid = {"pipeline": {"version": "p1"}, "a": {"b": 7}, "author": {"name": "me"}, "title": {"x": None}}
    assert got["a.md"] == {**WANT, **laid, "author": {**WANT["author"], "name": "me"}}
    assert got["h.md"] == {**laid, "a": {"b": 7, "c": 2}} and all(got[p] == laid for p in ("b.md", "c.md", "d.md", "e.md", "f.md", "g.txt"))
    assert back.where("path = 'a.md'").select(F.variant_get("metadata", "$.author.roles[1].name", "string")).first()[0] == "admin"
