"""Whole inputs, not prefixes or bounded parts of them: cases in which a cut would show."""

import hashlib
import random

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def test_toxicity_reads_words_whole(spark):
    from lodestone.llm import toxicity as tx

    rng = random.Random(4)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.choice((0, 1, 3, 9, 400)))) for _ in range(200)]
    whole = [np.concatenate(x) for x in zip(*tx.events(words))]
    for block in (1, 2, 7, 500):
        assert all((a == np.concatenate(b)).all() for a, b in zip(whole, zip(*tx.events(words, block))))
    model = tx.Model(*np.unique(whole[2], return_counts=True), np.ones(len(np.unique(whole[2]))))
    model.seen = np.random.default_rng(4).normal(size=len(model.seen))
    together, keys = model.ratios(words), dict(zip(model.keys.tolist(), model.seen.tolist(), strict=True))
    for i, w in enumerate(words):
        own = [keys[k] for _, _, found in tx.events([w]) for k in found.tolist()]
        spans = [sum(own[a : a + tx.SPAN]) for a in range(max(1, len(own) - tx.SPAN + 1))]
        assert np.allclose(together[i], [sum(own), len(w) + 1, max(spans)]) and (together[i] == model.ratios([w])[0]).all()
    for block in (1, 7, 20):  # words that go on in other blocks
        with pytest.MonkeyPatch.context() as m:
            m.setattr(tx, "events", lambda words, e=tx.events, b=block: e(words, b))
            assert np.allclose(model.ratios(words), together)
    assert len(whole[0]) == sum(map(len, words)) + len(words) and list(tx.events([])) == []
    plain = ["river", "stone", "garden", "window", "paper", "summer", "bridge", "letter", "north", "quiet"]
    data = []
    for i in range(900):
        text = [rng.choice(plain) for _ in range(30)]
        if i % 3 == 0:
            text[rng.randrange(20, 30)] = "zugkwox"
        data.append((i, rng.choice("-_ 　").join(text), int(i % 3 == 0)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int").repartition(4)
    model = tx.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    out = tx.score_texts(df, model).where("held_out").collect()
    hits, alarms = (sum(r["predicted"] == 1 and r["toxic"] == c for r in out) for c in (1, 0))
    assert hits >= 0.7 * sum(r["toxic"] for r in out) > 50 and alarms <= 0.02 * len(out)
    same = "-".join(["river"] * 40)
    ends = spark.createDataFrame([(1, same), (2, same + "-zugkwox"), (3, same + "-zugkwox" * 2)], "doc_id long, text string")
    assert len({r["score"] for r in tx.score_texts(ends, model).collect()}) == 3


def test_token_shards_query_writes_files(spark):
    import pytest

    from lodestone.llm.token_shards import SEQUENCE, SHARD_ROWS, checked_shards, op10_token_shards, read_slots

    found = op10_token_shards(spark, SF).orderBy("shard").collect()
    assert [r["shard"] for r in found] == list(range(len(found))) and found
    for r in found:
        with open(r["path"], "rb") as f:
            raw = f.read()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (2 * SEQUENCE * r["rows"], r["sha256"])
    folder = found[0]["path"].rsplit("/", 1)[0]
    n = sum(r["rows"] for r in found)
    slots = read_slots(folder, 0, n)
    assert n <= len(found) * SHARD_ROWS and slots.shape == (n, SEQUENCE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (slots == 50256).sum() - docs in range(SEQUENCE)  # an end mark a document, and padding
    bad = spark.createDataFrame([(r["shard"], r["rows"], "0" * 64, r["path"]) for r in found], "shard long, rows long, sha256 string, path string")
    with pytest.raises(Exception, match="isn't what was written"):
        checked_shards(bad, folder).collect()


def test_rules_grow_at_every_threshold():
    from lodestone.llm import quality_rules as q

    x = {"a": np.random.default_rng(5).permutation(20_000) / 20_000}
    for low in (x["a"] >= 0.99875, x["a"] < 0.00155, x["a"] >= 0.3333):
        rule = q._grow(x, low, 4)
        assert len(rule) == 1 and (q._covers(rule, x) == low).all()


def test_families_of_near_copies(spark):
    """Families just above and below the threshold, nested ones, and a common passage: no link is lost."""
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent))
    from test_llm import components, ordered

    from lodestone.llm import jaccard_join as jj

    rng, data = random.Random(7), []
    for c, (n, m) in enumerate([(150, 150), (60, 60)]):
        base = [f"b{c}_{j}" for j in range(n)]
        family = [base]
        for _ in range(m):
            words = list(rng.choice(family) if rng.random() < 0.3 else base)
            for _ in range(rng.randint(1, 8)):
                j, kind = rng.randrange(len(words)), rng.random()
                if kind < 0.4:
                    words[j] = f"x{rng.randrange(40)}"
                elif kind < 0.7:
                    del words[j]
                else:
                    words.insert(j, words[j - 1])
            family.append(words)
            data.append((len(data) * 7 % 5003, " ".join(words)))
    common = [f"l{j}" for j in range(40)]
    for k in range(100):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(2, 30))]
        data.append((6000 + k, " ".join(words[:5] + common + words[5:])))
    data.append((7000, " ".join(f"long{i}" for i in range(30_000))))
    data.append((7001, " ".join(f"long{i}" for i in range(200, 30_000))))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    verified = []
    keep = jj._verify

    def counted(n, percent):
        inner = keep(n, percent)
        folder = verified[0]

        def run(batches):
            import os
            import uuid

            for batch in batches:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.writelines(f"{u} {v}\n" for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()))
                yield from inner(iter([batch]))

        return run

    import os
    import tempfile

    verified.append(tempfile.mkdtemp(prefix="spark-"))
    jj._verify = counted
    try:
        got = ordered(jj.near_duplicates(df, 4, 85).collect())
    finally:
        jj._verify = keep
    assert got == ordered(components(data, 4, 85))
    pairs = [line for name in os.listdir(verified[0]) for line in open(os.path.join(verified[0], name))]
    assert pairs and len(pairs) == len(set(pairs))  # each pair is verified once


def test_hashes_of_texts_that_sums_of_powers_confuse(spark):
    """Complementary Thue-Morse strings collide under any polynomial modulo 2**64."""
    from lodestone.llm import jaccard_join as jj
    from lodestone.llm import quality_rules as q
    from lodestone.llm.common import Windows, span_hashes
    from lodestone.llm.suffix_dedup import remove_repeats

    a, b = "a", "b"
    while len(a) < 4096:
        a, b = a + b, b + a
    df = spark.createDataFrame([(1, a), (2, b), (3, a + "\n" + b)], "doc_id long, text string")
    counts = {r["doc_id"]: r for r in q.with_counts(df).collect()}
    assert (counts[3]["n_dup_lines"], counts[3]["n_distinct_words"]) == (0, 2)
    assert {r["doc_id"]: r["component_id"] for r in jj.near_duplicates(df, 4, 85).collect()} == {1: 1, 2: 2, 3: 3}
    alone = remove_repeats(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), width=4096).collect()
    assert [r["n_removed"] for r in alone] == [0, 0]
    data = np.frombuffer((a + b).encode(), np.uint8)
    start, end = np.array([0, 4096, 0, 1]), np.array([4096, 8192, 2048, 2049])
    for h in (span_hashes(data, start, end), Windows(data).spans(start, end)):
        assert len(set(h.tolist())) == 4


def test_pipeline_against_brute_force(spark):
    """run() against plain versions of its five stages, in order."""
    import re
    import sys
    from collections import Counter
    from pathlib import Path

    import public_tokenizers as P
    import tiktoken
    from pyspark.sql import functions as F

    sys.path.insert(0, str(Path(__file__).parent))
    from test_llm import components, ordered

    import corpus_pipeline
    from lodestone.llm import mixing as m
    from lodestone.llm import quality_rules as q
    from lodestone.llm.byte_bpe import load_ranks

    word = re.compile(rb"[^\x20\x09-\x0D]+")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in table.collect()}
    # 1: base rules, and the learned list read rule by rule
    rules = q.fit(table, spark.read.parquet(f"{SF}/labels.parquet"))
    counts = {r["doc_id"]: r.asDict() for r in q.with_counts(table.select("doc_id", "text")).collect()}
    kept = []
    for d, c in counts.items():
        ratio = {name: c[a] / max(c[b], 1) for name, a, b in q.RATIOS}
        low = any(all(ratio[n] >= at if op == ">=" else ratio[n] <= at for n, op, at in rule) for rule in rules)
        if c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"] and not low:
            kept.append(d)
    # 2
    kept = [d for d, _, c in components([(d, docs[d][0]) for d in kept], 5, 80) if d == c]
    # 3
    raw, seen, texts = {d: docs[d][0].encode() for d in kept}, Counter(), {}
    for t in raw.values():
        seen.update(t[i : i + 200] for i in range(len(t) - 199))
    for d, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        left = bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        if left == docs[d][0] or word.search(left.encode()):
            texts[d] = left
    # 4: each source in the order of its hashes, full passes and one in part
    frame = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    order = {r["doc_id"]: r["h"] for r in frame.select("doc_id", F.xxhash64(F.lit(6), "doc_id", F.xxhash64("text")).alias("h")).collect()}
    size = {d: len(word.findall(t.encode())) for d, t in texts.items()}
    sources = sorted({docs[d][1] for d in texts}, key=str.encode)
    total = {s: sum(size[d] for d in texts if docs[d][1] == s) for s in sources}
    goals = m.targets([total[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))])
    want = []
    bpe = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for s, goal in zip(sources, goals):
        full, before = int(goal // total[s]), 0
        for d in sorted((d for d in texts if docs[d][1] == s), key=lambda d: (order[d] % m.BUCKETS, order[d])):
            copies = full + (before + size[d] / 2 <= goal - full * total[s])
            before += size[d]
            ids = bpe.encode_ordinary(texts[d])
            # 5
            row = (d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[d].encode()).hexdigest())
            want += [row] * (copies if size[d] else 0)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert ordered(got) == ordered(want) and len(want) > 50


def test_shards_do_not_depend_on_file_splits(spark, tmp_path):
    import public_tokenizers as P

    from lodestone.llm.byte_bpe import load_ranks
    from lodestone.llm.common import materialize
    from lodestone.llm.token_shards import in_file_order, tokenise, training_rows

    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.option("parquet.block.size", 20_000).parquet(str(tmp_path / "d"))
    ranks, found = load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("30000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            tokens = materialize(tokenise(in_file_order(spark.read.parquet(str(tmp_path / "d"))), ranks, P.PATTERN, 50256), "tokens")
            found.append([tuple(r) for r in training_rows(tokens, length=64, shard_rows=100, pad=50256).select("slot", "ids").orderBy("slot").collect()])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found[0] == found[1] and len(found[0]) > 100


def test_models_against_plain_kneser_ney():
    """Every event's ratio against dictionaries of contexts."""
    from collections import Counter, defaultdict
    from math import log

    from lodestone.llm import toxicity as tx

    rng = random.Random(8)
    words = [[bytes(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60)] for letters in (b"abc", b"abd")]
    counts = [Counter(k for _, _, keys in tx.events(w) for k in keys.tolist()) for w in words]
    plain = []
    for group in words:
        found = Counter()
        for w in group:
            marked = b"\2" + w + b"\3"
            found.update((marked[max(0, i - tx.ORDER + 1) : i], marked[i]) for i in range(1, len(marked)))
        plain.append(found)
    events = sorted({*plain[0], *plain[1]})
    pack = lambda e: int.from_bytes(e[0] + bytes([e[1]]), "big")
    assert {pack(e): n for e, n in plain[0].items()} == counts[0] and {pack(e): n for e, n in plain[1].items()} == counts[1]

    def shorter(e, j):
        return (e[0][min(j, len(e[0])) :], e[1])

    shared = dict.fromkeys(events, 1 / 256)
    for j in range(tx.ORDER - 1, 0, -1):
        pairs = {(shorter(e, j), shorter(e, j - 1)) for e in events}
        kinds, per = defaultdict(set), Counter(a for a, _ in pairs)
        total = Counter()
        for a, n in per.items():
            kinds[a[0]].add(a)
            total[a[0]] += n
        for e in events:
            a = shorter(e, j)
            shared[e] = max(per[a] - tx.DISCOUNT, 0) / total[a[0]] + tx.DISCOUNT * len(kinds[a[0]]) / total[a[0]] * shared[e]
    keys = np.array([pack(e) for e in events], np.int64)
    order = np.argsort(keys)
    for discount in tx.CLASS_DISCOUNTS:
        p = []
        for found in plain:
            total, freed = Counter(), Counter()
            for e, n in found.items():
                total[e[0]] += n
                freed[e[0]] += min(n, discount)
            p.append({e: max(found[e] - discount, 0) / total[e[0]] + freed[e[0]] / total[e[0]] * shared[e] if total[e[0]] else shared[e] for e in events})
        want = {pack(e): log(p[0][e] / p[1][e]) for e in events}
        model = tx.Model(keys[order], *[np.array([c[k] for k in keys[order].tolist()], float) for c in counts], discount)
        assert np.allclose(model.seen, [want[k] for k in keys[order].tolist()])


def test_components_against_union_find(spark):
    from lodestone.llm.components import components

    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    rng.shuffle(chain)
    edges = chain + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(180)] + [(500, 500 + i) for i in range(1, 30)] + [(900, 900), (7, 8), (8, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame([*edges, (None, 1)], "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chat_records_that_used_to_fail(spark):
    from lodestone.llm import chat_format as c

    deep = "[" * 100_000 + "]" * 100_000
    records = ['{"question":"\\ud800 a","answer":"b"}', '{"prompt":"p","response":""}', '{"prompt":null,"response":"r"}', '{"instruction":"i","input":"","output":""}', deep, '{"a":' + deep + "}", '{"\\udfff":1}', "no", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "conv_id long, record string")
    out = c.format_records(df, c.default_registry()).cache()
    found = {r["conv_id"]: r for r in out.collect()}
    assert c.parse(found[0]["formatted"]) == [("user", "\ufffd a"), ("assistant", "b")] and "surrogate" in found[0]["problem"]
    assert c.parse(found[1]["formatted"]) == [("user", "p"), ("assistant", "")] and c.parse(found[2]["formatted"]) == [("user", ""), ("assistant", "r")]
    assert c.parse(found[3]["formatted"]) == [("user", "i"), ("assistant", "")]
    assert all(found[i]["formatted"] is None and found[i]["problem"] for i in (4, 5, 6, 7)) and found[8]["formatted"] == ""
    back = {r["conv_id"]: r for r in c.read_back(out).collect()}
    assert back[7]["n_turns"] is None and back[7]["turns_sha256"] is None and back[1]["n_turns"] == 2 and back[8]["n_turns"] == 0
    flat = spark.createDataFrame([(i, t, r, "") for i in range(40) for t, r in enumerate(("user", "assistant"))], "conv_id long, turn int, role string, text string")
    assert {r["n_turns"] for r in c.read_back(c.format_records(c.as_records(flat), c.default_registry())).collect()} == {2}


def test_token_shards_of_a_million_spaces(spark):
    import public_tokenizers as P

    from lodestone.llm.byte_bpe import load_ranks
    from lodestone.llm.token_shards import tokenise

    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    text = "a" + " " * 1_000_000 + "b"
    row = tokenise(spark.createDataFrame([(text,)], "text string"), ranks, P.PATTERN, 50256).first()
    ids = np.frombuffer(bytes(row["ids"]), "<u2")
    names = {v: k for k, v in ranks.items()}
    assert row["n"] == len(ids) and ids[-1] == 50256 and b"".join(names[int(i)] for i in ids[:-1]) == text.encode()


def test_token_counts_of_long_words():
    import tracemalloc

    import public_tokenizers as P

    from lodestone.llm import token_counts as tc

    trie = tc.TokenTrie(tc.load_pieces(P.path("piece_bpe_32k.model")))
    rng = random.Random(8)
    for n in (1, 5, 200, 255):
        for letters in ("ab", "the and of", "é漢x😀"):
            word = tc.MARK + "".join(rng.choice(letters) for _ in range(n))
            assert trie.alone(word) == trie.insert(word)
    tracemalloc.start()
    assert trie.total([b"ab" * 50_000]) > 0 and tracemalloc.get_traced_memory()[1] < 10e6
    tracemalloc.stop()
