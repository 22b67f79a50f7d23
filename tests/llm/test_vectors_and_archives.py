"""Whitening, vector codes and WARC archives against brute force and round trips."""

import gzip
import hashlib
import random
from collections import defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def odd_vectors(dims, n, seed=1):
    """(vec_id, embedding, label): with nulls, non-finite entries, other lengths, repeats, null keys and labels."""
    rng = random.Random(seed)
    rows = [(i * 3, [rng.gauss(0, 0.2 * (1 + j % 5)) for j in range(dims)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]
    rows += [rows[4], rows[4], (None, rows[5][1], 7), (None, [0.0] * dims, None), (1, [-0.5] * dims, 1), (1, [0.25] * dims, 1)]
    rows += [(2, None, 0), (5, [], 0), (7, [0.1] * (dims - 1), 0), (8, [NAN] + [0.0] * (dims - 1), 0), (11, [0.0] * (dims - 1) + [INF], 0), (14, [None] + [0.0] * (dims - 1), 0), (17, [-INF] * dims, 1)]
    rng.shuffle(rows)
    return rows


def kept_of(rows, dims):
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and abs(x) < INF for x in r[1])]


def frame(spark, rows, kind="double", parts=5):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("deviation", "code", "error", "key", "whitened")}).repartition(parts)


@pytest.mark.parametrize("dims,n,parts", [(16, 300, 5), (5, 40, 9), (3, 6, 4)])
def test_whitening_against_brute_force(spark, dims, n, parts):
    from lodestone.llm.whitening import whiten

    rows = odd_vectors(dims, n)
    kept = kept_of(rows, dims)
    x = [[floor(1024 * c) + 100000 for c in r[1]] for r in kept]
    m, sums = len(x), [sum(c) for c in zip(*x)]
    c = np.array([[float(Fraction(a * m - s, m)) for a, s in zip(row, sums)] for row in x])
    e, v = np.linalg.eigh(c.T @ c / m)
    e, v, k = e[::-1], v[:, ::-1], min(8, dims)
    by = defaultdict(list)
    for r in whiten(frame(spark, rows, parts=parts)).collect():
        by[r["vec_id"], r["deviation"]].append(r)
        assert r["n"] == m and r["identity_error"] < 1e-9
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12
    want = defaultdict(list)
    for r, row, centred in zip(kept, x, c):
        want[r[0], sum((a * m - s) ** 2 for a, s in zip(row, sums))].append(centred @ v[:, :k] / np.sqrt(e[:k]))
    assert {key: len(r) for key, r in by.items()} == {key: k * len(r) for key, r in want.items()}
    signs = {}
    for key, found in by.items():
        if len(want[key]) > 1:
            continue
        found = sorted(found, key=lambda r: r["component"])
        assert [r["component"] for r in found] == list(range(1, k + 1))
        for r, w in zip(found, want[key][0]):
            if abs(w) > 1e-3:
                assert signs.setdefault(r["component"], np.sign(w * r["whitened"])) == np.sign(w * r["whitened"])
            assert abs(abs(w) - abs(r["whitened"])) < 1e-8


def test_whitening_ends(spark):
    from lodestone.llm.whitening import LONGEST, apart, jacobi, squared_lengths, whiten

    empty = frame(spark, [])
    assert whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and whiten(empty).count() == 0
    assert whiten(frame(spark, [(1, None, 0), (2, [NAN], 0), (3, [], 0)])).count() == 0
    for alike in ([(1, [1.0, 2.0], 0)], [(i, [0.5, 0.5], 0) for i in range(40)]):
        assert {tuple(r)[1:] for r in whiten(frame(spark, alike)).collect()} == {(k, len(alike), 0, 0.0, 0.0, 1.0) for k in (1, 2)}
    line = whiten(frame(spark, [(i, [i / 8, i / 4], 0) for i in range(40)])).collect()  # one dimension too few
    assert {r["whitened"] for r in line if r["component"] == 2} == {0.0} and abs(line[0]["explained"] + line[1]["explained"] - 1) < 1e-12
    huge = {r["deviation"] for r in whiten(frame(spark, [(1, [1e300, 0.0], 0), (2, [-1e300, 3e5], 0)])).collect()}
    assert huge == {LONGEST}
    x = np.array([[3, -(1 << 52)], [(1 << 52), 5]])
    sums = tuple(int(s) for s in x.sum(0))
    assert apart(x, 10**7, sums).tolist() == [[int(a) * 10**7 - s for a, s in zip(r, sums)] for r in x]
    assert squared_lengths(np.array([[3, 4], [1 << 33, 0]])).tolist() == [25, LONGEST]
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (7, 7), (4, 9), (64, 64)):
        a = rng.normal(size=shape) * 10.0 ** rng.integers(-6, 6, shape[1])
        size, v = jacobi(a)
        assert np.allclose(size[: min(shape)], np.linalg.svd(a, compute_uv=False), rtol=1e-9, atol=1e-12 * size[0])
        assert np.abs(v.T @ v - np.eye(shape[1])).max() < 1e-12


def brute_codes(kept, dims, parts=16, entries=64, rounds=2):
    width = dims // parts
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, b"".join(np.array([floor(256 * c) for c in kept[i][1]], "<i4").tobytes() for _ in "1")))
    cells = [[[floor(256 * c) for c in r[1][p * width : (p + 1) * width]] for p in range(parts)] for r in kept]
    books = [[cells[i][p] for i in order[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for c in cells:
                got[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(got[i]) for x in zip(*got[i])] if i in got else e for i, e in enumerate(books[p])]
    flat = ",".join(str(x) for b in books for e in b for x in e)
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cells]
    by = defaultdict(int)
    for r, f in zip(kept, found):
        by[r[2]] += sum(d for d, _ in f)
    return [(r[0], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), by[r[2]], hashlib.sha256(flat.encode()).hexdigest()) for r, f in zip(kept, found)]


@pytest.mark.parametrize("n,kind", [(150, "double"), (30, "float")])
def test_vector_codes_against_brute_force(spark, n, kind):
    from lodestone.llm.vector_codes import vector_codes

    rows = odd_vectors(32, n)
    df = frame(spark, rows, kind)
    kept = kept_of([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()], 32)
    out = vector_codes(df)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, brute_codes(kept, 32)))


def test_vector_codes_ends(spark):
    from lodestone.llm.vector_codes import Exponion, compress, vector_codes

    assert vector_codes(frame(spark, [])).count() == 0 and vector_codes(frame(spark, [(1, [], 0), (2, None, 1)])).count() == 0
    one = vector_codes(frame(spark, [(9, [1.0] * 20, None)])).collect()  # 16 doesn't divide 20
    assert [tuple(r)[:4] for r in one] == [(9, "00" * 16, 0, 0)]
    far = vector_codes(frame(spark, [(1, [1e30] * 16, None), (2, [-1e30] * 16, None)])).collect()
    assert [r["error"] for r in far] == [0, 0]
    same = vector_codes(frame(spark, [(i, [0.1] * 16, 0) for i in range(300)])).collect()
    assert {r["code"] for r in same} == {"00" * 16}  # of equal entries the first
    rows, books = compress(frame(spark, odd_vectors(32, 60)), parts=4, entries=5, rounds=3)
    assert books.shape == (4, 5, 8) and {len(r["code"]) for r in rows.collect()} == {4}
    with pytest.raises(ValueError, match="256"):
        compress(frame(spark, []), entries=300)
    rng = np.random.default_rng(5)
    for size, span in ((64, 6), (64, 300), (7, 2), (1, 9)):
        book, x = rng.integers(-span, span, (size, 3)), rng.integers(-span, span, (400, 3))
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        for start in (np.zeros(400, int), rng.integers(0, size, 400)):
            at, best = Exponion(book).nearest(x, start)
            assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def pages_of(spark, rows):
    df = spark.createDataFrame([(f"00000000-0000-0000-0000-{i:012d}", *r) for i, r in enumerate(rows)], "record string, page_id long, url string, html string")
    return df.withColumns({c: F.lit("clash") for c in ("chunk", "head", "digest", "size", "key", "data")}).repartition(4)


def test_archives_against_brute_force(spark, tmp_path):
    from lodestone.llm import warc as W

    rng = random.Random(2)
    long, tricky = "".join(rng.choice("abcdefgh é\n") for _ in range(40_000)), "WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40
    rows = [(i, f"http://x.org/{i}", t) for i, t in enumerate([long, long, "short", "short", "", None, tricky, tricky, "x" * 999, "x" * 999, "x" * 1000, "x" * 1000, "é" * 500, "é" * 500, long + "!"])]
    rows += [rows[0], rows[1], rows[1], (None, "http://a b\r\nEvil: 1/ü", long), (None, None, "lost"), (None, None, None), (-5, "", tricky)]
    pages = pages_of(spark, rows)
    decided = W.decide(pages)
    archives = W.write_archives(decided, W.payload_chunks(pages, chunk=777), f"file://{tmp_path}/a", archive=20_000)
    assert archives.count() > 1 and sum(r["records"] for r in archives.collect()) == len(rows)
    chunks = W.read_chunks(archives, chunk=1000).cache()
    got = W.records_of(chunks).collect()
    groups = defaultdict(list)
    for page, _, t in rows:
        groups[t or ""].append(page)
    want = []
    for t, ids in groups.items():
        raw, ids = (t or "").encode(), sorted(ids, key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            again = len(raw) >= 1000 and k < len(ids) - 1
            want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", ids[-1] if again else None))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    assert all(r["stated_digest"] == r["payload_digest"] for r in got)
    whole, urls = defaultdict(bytes), {}
    for r in sorted(chunks.where("problem IS NULL").collect(), key=lambda r: (r["archive"], r["offset"], r["chunk"])):
        assert len(r["data"]) <= 1000
        whole[r["record_id"]] += bytes(r["data"])
        assert r["size"] == len(whole[r["record_id"]]) and r["digest"] == hashlib.sha1(whole[r["record_id"]]).hexdigest()
        if r["last"]:
            urls[r["record_id"]] = r["fields"]
    for i, (page, url, t) in enumerate(rows):
        name = f"<urn:uuid:00000000-0000-0000-0000-{i:012d}>"
        if urls[name]["warc-type"] == "response":
            assert whole[name] == (t or "").encode()
        assert "evil" not in urls[name] and ("warc-target-uri" in urls[name]) == (url is not None)
    for r in chunks.where("last AND chunk = 0").limit(5).collect():  # a record's offset is where its member begins
        with open(r["archive"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            assert gzip.GzipFile(fileobj=f).read(5) == b"WARC/"
    none = pages_of(spark, [])
    nothing = W.write_archives(W.decide(none), W.payload_chunks(none), f"file://{tmp_path}/b")
    assert nothing.count() == 0 and W.records_of(W.read_chunks(nothing)).count() == 0


def test_archives_of_others(spark, tmp_path):
    from lodestone.llm.warc import hex_digest, read_chunks, records_of

    digest = hashlib.sha1(b"body").hexdigest()
    one = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:1>\r\nPage-ID: 4\r\nFolded: a\r\n b\r\nwarc-payload-digest: SHA1:{digest}\r\nContent-Type: application/http\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n".encode()
    two = b"WARC/1.0\nWARC-Type: resource\nContent-Type: text/plain\nContent-Length: 3\n\nabc\n\n"
    bare = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 10\r\n\r\nHTTP/1.1 2\r\n\r\n"  # the block ends within the HTTP header
    files = {"plain.warc": one + two + one + bare, "one.warc.gz": gzip.compress(one + two + one + bare), "many.warc.gz": b"".join(map(gzip.compress, (one, two, one, bare)))}
    broken = {"cut.warc.gz": files["many.warc.gz"][:-40], "short.warc": (one + two)[:-6], "other.warc": one + b"hello\r\n", "length.warc": one + b"WARC/1.0\r\nContent-Length: x\r\n\r\n", "bad.warc.gz": gzip.compress(one) + b"\x1f\x8b" + b"\0" * 40, "none.warc": b""}
    for name, data in {**files, **broken}.items():
        (tmp_path / name).write_bytes(data)

    def read(names):
        return read_chunks(spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in names], "path string"))

    for name in files:
        rows = read([name]).collect()
        assert [(r["fields"]["warc-type"], bytes(r["data"]), r["problem"]) for r in rows] == [("response", b"body", None), ("resource", b"abc", None), ("response", b"body", None), ("response", b"", None)]
        assert rows[0]["fields"]["folded"] == "a b" and rows[0]["fields"]["http"] == "HTTP/1.1 200 OK"
    assert records_of(read(["plain.warc"])).where("page_id = 4").distinct().collect()[0][1:] == (4, digest, "response", None, digest)
    problems = {n: [r["problem"] for r in read([n]).collect()] for n in broken}
    assert problems.pop("none.warc") == []
    assert all(p[0] is None and p[-1] and not any(p[:-1]) for p in problems.values())
    with pytest.raises(Exception, match="no record begins"):
        records_of(read(["other.warc"])).collect()
    raw = [hashlib.sha1(bytes([i])).digest() for i in range(50)]
    import base64

    told = spark.createDataFrame([(f"sha1:{base64.b32encode(d).decode()}", d.hex()) for d in raw], "told string, hex string")
    assert told.where(hex_digest(F.col("told")) != F.col("hex")).count() == 0


def test_whitening_query_against_eigenvectors(spark):
    from lodestone.llm.whitening import op11_whitening

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r["embedding"] for r in rows], float)).astype(np.int64) + 100000
    n = len(x)
    d = x * n - x.sum(0)
    c = d / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    want = np.abs(c @ v[:, :8] / np.sqrt(e[:8]))
    found = op11_whitening(spark, sf).collect()
    assert len(found) == 8 * n
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    for r in found:
        i, k = place[r["vec_id"]], r["component"] - 1
        assert abs(abs(r["whitened"]) - want[i, k]) < 1e-8 and r["n"] == n and r["deviation"] == int((d[i] ** 2).sum())
        assert abs(r["explained"] * e.sum() / e[k] - 1) < 1e-9 and r["identity_error"] < 1e-9


@pytest.mark.parametrize("name", ["op12_warc", "op13_vector_codes"])
def test_queries_against_sql(spark, name):
    import duckdb

    from lodestone.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
