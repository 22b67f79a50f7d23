"""Many searches at once against one at a time."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import batch_search as bs
from lodestone.operators import lexical_index as li
from lodestone.operators import search as se

QUERIES = ["alpha beta", '"alpha beta" gamma -"x1 x1"', "alpha -gamma", '"beta gamma" or delta alpha', "beta", "zeta", "", "f1", "eta/f3", "BETA", "a%t", "_", None, "delta delta"]


def key(r):
    return (str(r["query_id"]), r["rank"])


def test_each_query_gets_its_own_search(spark, tmp_path):
    rng, words = random.Random(11), ["alpha", "beta", "gamma", "delta", "x1"]
    rows = [(i, f"{rng.choice(words)}/f{i}.txt", " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 3, 9, 30)))), rng.choice([None, "Beta"]), None) for i in range(70)]
    parts = spark.createDataFrame(rows, "chunk_id long, path string, content string, symbol string, heading string").cache()
    index = li.append(li.LexicalIndex(spark, f"file://{tmp_path}/i"), parts.where("chunk_id < 50"))
    li.append(index, parts.where("chunk_id >= 40"), parts.where("chunk_id between 40 and 49").select("chunk_id"))
    vectors = {i: [rng.gauss(0, 1) for _ in range(4)] for i in range(65)}
    e = spark.createDataFrame([*vectors.items(), (500, None), (501, [0.0] * 4), (502, [1.0]), (66, vectors[3])], "chunk_id long, embedding array<double>")
    asked = [(i, q, vectors.get(i, None) if i != 5 else [0.0] * 4) for i, q in enumerate(QUERIES)]
    queries = spark.createDataFrame(asked, "query_id long, query string, vector array<double>").cache()
    lex = bs.lexical(index, queries, 9).collect()
    near = bs.nearest(e, queries, 12).collect()
    both = bs.search(index, queries, e.where("chunk_id < 70"), 6).collect()
    for i, q, v in asked:
        got = sorted([(r["lex_rank"], r["chunk_id"], r["path_match"], round(r["lexical_rank"], 9), r["similarity"]) for r in lex if r["query_id"] == i])
        want = [] if q is None else [(r["lex_rank"], r["chunk_id"], r["path_match"], round(r["lexical_rank"], 9), r["similarity"]) for r in se.lexical(parts, q, 9).orderBy("lex_rank").collect()]
        assert got == want, q
        if v and any(v) and i < 3:
            exact = se.nearest(e.where("size(embedding) = 4"), F.array(*map(F.lit, v)), 12).where("score IS NOT NULL").orderBy("vec_rank").collect()
            assert sorted((r["vec_rank"], r["chunk_id"], r["score"]) for r in near if r["query_id"] == i) == [(r["vec_rank"], r["chunk_id"], r["score"]) for r in exact]
            fused = se.search(parts, e.where("size(embedding) = 4"), q, F.array(*map(F.lit, v)), "hybrid", 6).orderBy("rank").collect()
            assert [(r["rank"], r["chunk_id"], round(r["fused"], 9)) for r in sorted(both, key=key) if r["query_id"] == i] == [(r["rank"], r["chunk_id"], round(r["fused"], 9)) for r in fused]
    assert not [r for r in near if r["query_id"] in (5,)]
    relevant = spark.createDataFrame([(0, lex[0]["chunk_id"]), (4, -1)], "query_id long, chunk_id long")
    found = {r["query_id"]: r for r in bs.cases(queries, bs.search(index, queries, None, 6), relevant).collect()}
    assert len(found) == len(QUERIES) and found[4]["answerable"] and found[4]["first_rank"] is None and found[12]["n_results"] == 0 and not found[12]["answerable"]
    with pytest.raises(Exception, match="without the index"):
        bs.lexical(index, spark.createDataFrame([(1, "-alpha")], "query_id long, query string"), 3).collect()
