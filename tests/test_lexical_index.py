"""The segmented lexical index against a scan of what is live."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import lexical_index as li
from lodestone.operators import search as se

SCHEMA = "chunk_id long, path string, content string, symbol string, heading string"
QUERIES = ("alpha beta", '"alpha beta" gamma', "alpha -gamma", '"beta gamma" or delta', "beta", "zeta", "", '"alpha head" -"beta beta"', "f1", "eta/f3", "BETA", "a%t", "_", "gamma/f100.txt")


def made(rng, ids):
    words = ["alpha", "beta", "gamma", "delta", "x1"]
    return [(i, f"{rng.choice(words)}/f{i}.txt", " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 3, 9, 40)))), rng.choice([None, "Beta", "other"]), rng.choice([None, "alpha head"])) for i in ids]


def plain(rows):
    return [(r["chunk_id"], r["path_match"], round(r["lexical_rank"], 9), r["similarity"], r["lex_rank"]) for r in rows]


def agrees(spark, index, live, queries=QUERIES, limits=(9,)):
    parts = spark.createDataFrame(live, SCHEMA).cache()
    for query in queries:
        for limit in limits:
            got = plain(li.lexical(index, query, limit).orderBy("lex_rank").collect())
            assert got == plain(se.lexical(parts, query, limit).orderBy("lex_rank").collect()), (query, limit)
    parts.unpersist()


def test_index_through_its_life(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(li, "GROUP", 8)
    monkeypatch.setattr(li, "FIRST", 2)
    monkeypatch.setattr(li, "FEW", 2)
    rng = random.Random(6)
    index = li.LexicalIndex(spark, f"file://{tmp_path}/i")
    assert li.lexical(index, "alpha", 5).count() == 0 and li.merge(index) is index
    live = {r[0]: r for r in [*made(rng, range(90)), (500, "none", None, None, None), (501, None, "alpha beta", None, None), (502, "", "", "", "")]}
    frame = lambda rows: spark.createDataFrame(list(rows), SCHEMA)
    ids = lambda found: spark.createDataFrame([(i,) for i in found], "id long")
    agrees(spark, li.append(index, frame(live.values())), [*live.values()], QUERIES[::2], (500,))

    new = {r[0]: r for r in [*made(rng, range(60, 130)), (503, "zz", None, None, None)]}
    li.append(index, frame(new.values()), ids(range(60, 90)))
    live |= new
    li.remove(index, ids([1, 2, 3, 500, 99999]))
    live = {k: v for k, v in live.items() if k not in (1, 2, 3, 500)}
    agrees(spark, index, [*live.values()], QUERIES[:5:2])
    back = made(rng, [2, 3])  # ids that were removed come back
    li.append(index, frame(back))
    live |= {r[0]: r for r in back}
    monkeypatch.setattr(li, "LISTED", 3)  # more groups than a filter may list
    agrees(spark, index, [*live.values()], QUERIES[1:5:3])
    monkeypatch.setattr(li, "LISTED", 10_000)

    state = index.state()
    assert [s[2] for s in state.segments] == [93, 71, 2] and len(state.removed) == 2
    li.merge(index, [state.segments[0][0], state.segments[2][0]])
    agrees(spark, index, [*live.values()], QUERIES[1::9])
    li.tidy(index, 2)  # 71 and 61 chunks are of unlike size
    assert len(index.state().segments) == 2
    li.merge(index)
    after = index.state()
    assert len(after.segments) == 1 and after.segments[0][2] == len(live) and not after.removed
    agrees(spark, index, [*live.values()], QUERIES[::6])
    li.append(index, frame([]), ids([]))
    li.append(index, frame([(900, "only/name", None, None, None)]))
    agrees(spark, index, [*live.values(), (900, "only/name", None, None, None)], ["name", "alpha"])
    with pytest.raises(Exception, match="exist"):  # another writer was first
        index.commit(li.State(index.state().number, "bigint"))
    with pytest.raises(ValueError, match="without the index"):
        li.lexical(index, "-alpha", 5)
    with pytest.raises(ValueError, match="chunk_id is string"):
        li.append(index, frame([]).withColumn("chunk_id", F.lit("a")))


def test_search_reads_few_postings_and_paths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(li, "GROUP", 32)
    monkeypatch.setattr(li, "FEW", 8)
    rows = [(i, f"d{i % 7}/file{i}.md", "common " * (1 + (i * i) % 97 % (40 if i % 50 == 0 else 3)) + ("rare " * (1 + i % 3) if i % 400 == 0 else "") + "filler " * (i % 11), None, None) for i in range(4000)]
    parts = spark.createDataFrame([*rows, (5000, "small rings/alpha", "x", None, None)], SCHEMA)
    index = li.append(li.LexicalIndex(spark, f"file://{tmp_path}/i"), parts)
    state = index.state()
    for query in ("common rare", "common"):
        branches = tx.parse_search(query)
        blocks = li._blocks(index, branches[0].terms, state)
        groups = li.chosen_groups(index, branches, 10, state)
        read, there = (b.agg(F.sum("n")).first()[0] for b in (li._within(blocks, groups), blocks))
        assert read < 0.5 * there, (query, read, there)
        assert plain(li.lexical(index, query, 10).collect()) == plain(se.lexical(parts, query, 10).collect())
    near = li.path_candidates(index, "small rings")
    assert 1 <= near.count() < 50 and li.path_candidates(index, "..") is None
    assert [r[0] for r in li.lexical(index, "small rings", 10).collect()] == [5000]
    only = spark.createDataFrame([(i,) for i in range(0, 4000, 3)], "chunk_id long")
    want = se.lexical(parts.join(only, "chunk_id", "left_semi"), "common rare", 10)
    assert plain(li.lexical(index, "common rare", 10, only).collect()) == plain(want.collect())


def test_path_candidates_at_the_cut(spark, tmp_path):
    """Three shared of twenty is just enough, as a 32-bit 0.15 is above 0.15."""
    rng = random.Random(9)
    paths = sorted({"".join(rng.choice("abc/ ") for _ in range(rng.randint(1, 14))) for _ in range(400)})
    rows = [(i, p, None, None, None) for i, p in enumerate(paths)]
    parts = spark.createDataFrame(rows, SCHEMA).cache()
    index = li.append(li.LexicalIndex(spark, f"file://{tmp_path}/i"), parts)
    grams = {r[0]: set(r[1]) for r in parts.select("chunk_id", tx.trigrams(F.col("path"))).collect()}
    cut = 0
    for query in ("abcab", "bca/cab abc", "a", "aa bb cc abc ccc"):
        wanted = set(spark.range(1).select(tx.trigrams(F.lit(query))).first()[0])
        cut += sum(20 * len(g & wanted) == 3 * len(g | wanted) > 0 for g in grams.values())
        assert plain(li.lexical(index, query, 1000).orderBy("lex_rank").collect()) == plain(se.lexical(parts, query, 1000).orderBy("lex_rank").collect())
    assert cut > 0


def test_fingerprint_follows_the_files(spark, tmp_path):
    place = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(place)
    before = li.fingerprint(spark, place)
    assert before == li.fingerprint(spark, place) and len(before) > 1
    spark.range(4).write.mode("overwrite").parquet(place)
    assert before != li.fingerprint(spark, place)


def test_compounds_whole_and_by_part(spark, tmp_path):
    texts = ["see README.md, or foo-bar.", "foo bar readme md", "http://Host.example.org/a/b?q=1 -x- a--b", "mail a.b@c.org 3.14", "", None, "foo-bar baz foo-bar", "é-É"]
    frame = spark.createDataFrame([(i, f"d/{i}", t, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r[0]: r[1] for r in frame.select("chunk_id", tx.compound_tokens(F.col("content"))).collect()}
    assert got[0] == ["see", "readme.md", "readme", "md", "or", "foo-bar", "foo", "bar"] and got[4] == [] and got[5] is None
    assert got[2] == ["http", "host.example.org/a/b", "host", "example", "org", "a", "b", "q", "1", "x", "a", "b"]
    assert got[3] == ["mail", "a.b@c.org", "a", "b", "c", "org", "3.14", "3", "14"] and got[7] == ["é-é", "é", "é"]
    assert all(tx.compounds_of(t) == got[i] for i, t in enumerate(texts) if t is not None)

    assert spark.range(1).select(F.size(tx.compound_tokens(F.repeat(F.lit("ab-"), 300_000)))).first()[0] == 300_001  # one long run

    index = li.append(li.LexicalIndex(spark, f"file://{tmp_path}/i", compounds=True), frame)
    li.append(index, spark.createDataFrame([(9, "d/9", "foo-bar", None, None)], SCHEMA))
    again = li.LexicalIndex(spark, index.folder)  # its state says how it was cut
    more = frame.unionByName(spark.createDataFrame([(9, "d/9", "foo-bar", None, None)], SCHEMA)).cache()
    found = {"foo-bar": [0, 6, 9], "README.md": [0], "foo": [0, 1, 6, 9], '"bar baz"': [6], "foo -foo-bar": [1], "host.example.org/a/b": [2], "http://host.example.org/a/b": [2], "example": [2]}
    for query, ids in found.items():
        rows = li.lexical(again, query, 20).collect()
        assert sorted(r["chunk_id"] for r in rows if r["lexical_rank"] > 0) == ids, query
        assert plain(rows) == plain(se.lexical(more, query, 20, compounds=True).collect()), query
    li.merge(again)
    assert index.state().compounds and [r["chunk_id"] for r in li.lexical(index, "readme.md", 5).where("lexical_rank > 0").collect()] == [0]
