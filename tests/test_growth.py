"""What a job shuffles and holds, where it must not grow with more than its input."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import batch_search as bs
from lodestone.operators import chunking as ch
from lodestone.operators import graph_index as gi
from lodestone.operators import lexical_index as li
from lodestone.operators import search as se

SCHEMA = "chunk_id long, path string, content string, symbol string"


@pytest.fixture
def shuffled(spark):
    """A function: (records, bytes) written to shuffles since it was last called."""
    seen, sc = set(), spark.sparkContext

    def since():
        none, no_numbers = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)
        stages, records, size = sc._jsc.sc().statusStore().stageList(none, False, False, no_numbers, none).iterator(), 0, 0
        while stages.hasNext():
            s = stages.next()
            if s.stageId() not in seen:
                seen.add(s.stageId())
                records, size = records + s.shuffleWriteRecords(), size + s.shuffleWriteBytes()
        return records, size

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if tables were large
    since()
    yield since
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_places_are_not_shuffled(spark, tmp_path, shuffled):
    rng = random.Random(3)
    rows = [(i, f"p/{i}", words(rng, 400), None) for i in range(100)]
    index = li.append(li.LexicalIndex(spark, f"file://{tmp_path}/i"), spark.createDataFrame(rows, SCHEMA))
    assert shuffled()[0] < 3000  # texts and trigrams, not 38,000 places
    li.remove(index, spark.createDataFrame([(i,) for i in range(0, 100, 3)], "id long"))
    shuffled()
    blocks = index.rows("blocks", index.state()).count()
    shuffled()
    li.merge(index)
    assert shuffled()[0] < blocks + 3000 < 30_000
    held = {(r["token"], r["chunk_id"]): r["places"] for r in li.postings(index.rows("blocks", index.state()), "token").collect()}
    want = {}
    for i, _, text, _ in rows:
        for at, word in enumerate(text.split()) if i % 3 else ():
            want.setdefault((word, i), []).append(at)
    assert held == want


def test_rare_tokens_of_many_groups_share_blocks(spark, tmp_path, shuffled, monkeypatch):
    monkeypatch.setattr(li, "GROUP", 32)
    rng = random.Random(9)
    texts = {i: " ".join(["often", *(f"w{1000 + rng.randrange(2000)}" for _ in range(40)), "x.y"]) for i in range(512)}
    index = li.append(li.LexicalIndex(spark, f"file://{tmp_path}/i", compounds=True), spark.createDataFrame([(i, f"p/{i}", t, None) for i, t in texts.items()], SCHEMA))

    def rows(ids):
        group = {r["chunk_id"]: r["group"] for r in index.rows("names", index.state()).collect()}
        blocks = index.rows("blocks", index.state())
        held = {(r["token"], r["chunk_id"]): (r["group"], r["places"]) for r in li.postings(blocks, "group", "token").collect()}
        want = {}
        for i in ids:
            for at, word in enumerate([*texts[i].split()[:-1], "x.y", "x", "y"]):
                want.setdefault((word, i), (group[i], []))[1].append(at)
        assert held == want and len(set(group.values())) > 4
        heads = {tuple(r) for r in li.bounds(index, [tx.Branch(words=["w1000"])], index.state()).select("group", "bound").collect()}
        most = {}
        for (word, _), (g, places) in held.items():
            if word == "w1000":
                most[g] = max(most.get(g, 0), len(places))
        assert heads == {(g, n * tx.WEIGHT) for g, n in most.items()}
        return blocks.count()

    assert rows(texts) < 4000  # not one for each of 15,000 pairs of token and group
    li.remove(index, spark.createDataFrame([(i,) for i in range(0, 512, 3)], "id long"))
    shuffled()
    li.merge(index)
    assert shuffled()[0] < 10_000
    left = [i for i in texts if i % 3]
    assert rows(left) < 4000
    li.append(index, spark.createDataFrame([(1000 + i, f"q/{i}", texts[i], None) for i in range(64)], SCHEMA))
    texts |= {1000 + i: texts[i] for i in range(64)}
    li.merge(index)
    assert rows([*left, *range(1000, 1064)]) < 4000


def test_a_task_sorts_its_tokens_in_runs(monkeypatch):
    rng = random.Random(10)
    docs = [(g, 10 * g + i // 2, [f"t{rng.randrange(30)}" for _ in range(rng.randrange(9))]) for g in range(6) for i in range(12)]  # ids come twice
    table = pa.table({"chunk_id": [d[1] for d in docs], "part": pa.array([-1 - (d[0] > 3) for d in docs], pa.int64()), "group": pa.array([d[0] for d in docs], pa.int64()), "toks": pa.array([d[2] for d in docs], pa.list_(pa.string()))})
    want = {}
    for g, i, toks in docs:
        for at, t in enumerate(toks):
            want.setdefault((g, t, i), []).append(at)
    for size, held in ((5, 1), (7, 60), (100, 1000)):
        monkeypatch.setattr(li, "HELD", held)
        found = {}
        for b in li._blocks_of(iter(table.to_batches(size)), 3):
            tokens = b.column("token").to_pylist()
            assert tokens == sorted(tokens)
            for r in b.to_pylist():
                cuts = zip([0, *r["ends"]], r["ends"])
                for k, (i, (a, z)) in enumerate(zip(r["ids"], cuts, strict=True)):
                    found[(r["groups"][k] if r["group"] < 0 else r["group"], r["token"], i)] = r["places"][a:z]
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}, size


def test_blocks_of_repeated_and_null_ids_over_batches():
    ids = [None, None, 1, 2, 2, 2, 3]
    group, toks = [7, 7, 7, 9, 9, 9, 9], [["a"], ["b", "a"], ["a", "a"], ["c"], None, ["d", "c"], []]
    rows = pa.table({"chunk_id": pa.array(ids, pa.int64()), "group": pa.array(group, pa.int64()), "toks": pa.array(toks, pa.list_(pa.string()))})
    for size in (1, 2, 3, 7):
        found = {}
        for b in li._blocks_of(iter(rows.to_batches(size))):
            for r in b.to_pylist():
                cuts = zip([0, *r["ends"]], r["ends"])
                held = dict(zip(r["ids"], (r["places"][a:b] for a, b in cuts), strict=True))
                assert r["n"] == len(held) and r["most"] == max(map(len, held.values()))
                found |= {(r["group"], r["token"], k): v for k, v in held.items()}
        assert found == {(7, "a", None): [0, 1], (7, "b", None): [0], (7, "a", 1): [0, 1], (9, "c", 2): [0, 1], (9, "d", 2): [0]}, size


def test_common_path_trigrams_make_no_pairs(spark, tmp_path, shuffled):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(("doctor", "source", "texts", "dream", "simple", "other", "violet", "number", "garden", "yellow")) + rng.choice("abcdefgh") for _ in range(12))
    rows = [(i, f"src{i % 5}/doc{i}.txt", f"w{i}", None) for i in range(2000)]
    index = li.append(li.LexicalIndex(spark, f"file://{tmp_path}/i"), spark.createDataFrame([*rows, (5000, "x/doctora sourceb.txt", "z", None)], SCHEMA))
    asked = [(i, text()) for i in range(40)] + [(100, "doctora sourceb"), (101, "src3 doc77 txt"), (102, "doc1999"), (103, "c4/doc9")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    shuffled()
    got = sorted((r["query_id"], r["chunk_id"]) for r in bs.named_chunks(index, queries.where("query_id < 100"), index.state()).collect())
    assert shuffled()[0] < 10_000
    got += sorted((r["query_id"], r["chunk_id"]) for r in bs.named_chunks(index, queries.where("query_id >= 100"), index.state()).collect())
    names = spark.createDataFrame([(r[0], r[1]) for r in [*rows, (5000, "x/doctora sourceb.txt")]], "chunk_id long, path string")
    like = tx.similarity(tx.trigrams(F.col("path")), tx.trigrams(F.col("query"))).cast("double") > tx.SIMILARITY_CUT
    want = names.crossJoin(queries).where(like | F.col("path").contains(F.col("query"))).select("query_id", "chunk_id")
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) > 100


def test_many_searches_open_few_postings(spark, tmp_path, shuffled):
    rng = random.Random(5)
    rows = [(i, f"p/{i}", " ".join(f"c{k}" for k in range(60)) + f" rare{i} {words(rng, 5)}", None) for i in range(600)]
    index = li.append(li.LexicalIndex(spark, f"file://{tmp_path}/i"), spark.createDataFrame(rows, SCHEMA))
    queries = spark.createDataFrame([(i, " ".join(f"c{k}" for k in range(60)) + f" rare{i}") for i in range(0, 600, 60)], "query_id long, query string")
    shuffled()
    ranks = bs.text_ranks(index, queries, index.state()).collect()
    assert shuffled()[0] < 10_000  # not 36,000 postings, and again for their counts
    assert sorted((r["query_id"], r["chunk_id"]) for r in ranks) == [(i, i) for i in range(0, 600, 60)]


def test_texts_stay_where_they_are_for_a_few_results(spark, shuffled):
    rng = random.Random(6)
    rows = [(i, f"p/{i}", words(rng, 300), None, None, 1, 1) for i in range(400)]
    chunks = spark.createDataFrame(rows, SCHEMA + ", heading string, start_line int, end_line int")
    lex = spark.createDataFrame([(i, 1.0, i + 1) for i in range(20)], "chunk_id long, lexical_rank double, lex_rank int")
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(200)]) for i in range(0, 800, 2)], "chunk_id long, embedding array<double>")
    query = F.array(*[F.lit(float(x)) for x in rows[0][2].encode()[:200]])
    packed = se.rag_context(chunks, vectors, "a", query, 10, 5000, lex=lex).collect()
    shown = se.present(se.search(chunks, vectors, "a", query, "hybrid", 10, lex=lex), chunks).collect()
    assert shuffled()[1] < 200_000  # the texts have more
    assert len(shown) == 10 and 0 < len(packed) <= 10 and all(r["content"] == rows[r["chunk_id"]][2] for r in packed)


def test_long_texts_are_handed_over_in_parts(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["\n".join("x" * rng.randrange(90) for _ in range(rng.choice((1, 30, 400)))) for _ in range(40)]
    frame = spark.createDataFrame([(i, f"k{i}", 3, t) for i, t in enumerate(texts)], "id long, k string, start_line int, content string")
    monkeypatch.setattr(ch, "HELD", 5000)
    out = ch.split_long(frame, ["id", "k"], 1000)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    got = sorted(tuple(r) for r in out.collect())
    want = []
    for i, t in enumerate(texts):
        rows = t.splitlines()
        cuts = ch.windows_of([len(x) for x in rows], 1000) if len(t) > 1000 else [(0, max(1, len(rows)))]
        want += [(i, f"k{i}", n, 3 + a, 2 + b, "\n".join(rows[a:b]) if len(t) > 1000 else t) for n, (a, b) in enumerate(cuts)]
    assert got == sorted(want) and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)


def test_linking_holds_few_similarities():
    x = np.random.default_rng(8).normal(size=(3000, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    tracemalloc.start()
    at, sim = gi._nearest(x, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 << 20
    s = x[:50] @ x.T
    s[np.arange(50), np.arange(50)] = -np.inf
    assert np.allclose(sim[:50], -np.sort(-s, 1)[:, :20]) and np.allclose(np.take_along_axis(s, at[:50], 1), sim[:50])
