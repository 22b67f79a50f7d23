"""Queries against their SQL on tables in which a cut would show."""

import duckdb


def test_retrieval_cases_of_odd_items(spark, tmp_path):
    from lodestone.plans.search_queries import CASES_SQL, retrieval_cases

    texts = ["alpha", "beta gamma", "one two three", "one two three four one two", "x" * 40 + " yy zz " + "w" * 30, "--", "a b c d e f", "never met anywhere at all", None, "", "this or that", "src0 doc1 txt", "doc17.txt"]
    docs = [(8 * i + 1, text) for i, text in enumerate(["alphabet soup alpha", "say beta gamma ray", "bone two threefold", "four one two three, one two three four one two", "x" * 40 + " yy zz " + "w" * 90, "dash -- dash", "a b c d e f g", "Alpha", None, "", "that and this", "this or that", "c d e f a b"])]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    write(list(enumerate(texts)), "item_id long, text string", "benchmark")
    write([(i, f"src{i % 2}", text) for i, text in docs], "doc_id long, source string, text string", "documents")
    write([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>", "embeddings")
    con = duckdb.connect()
    for name in ("benchmark", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got, want = retrieval_cases(spark, str(tmp_path)), con.sql(CASES_SQL)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and len(rows) == len(texts) and sum(r[1] for r in rows) >= 4
