"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one two"), (9005, "ONE two"), (9006, "one two three"), (9007, "x " * 400), (None, "lonely text here now"), (None, None)]


@pytest.fixture(scope="module")
def rows(spark):
    found = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return [*found, *ODD, (5, found[9][1]), found[7], (None, found[3][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def ordered(found):
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is None, x) for x in r))


def test_repeats_against_brute_force(docs, rows, empty):
    from lodestone.llm.suffix_dedup import remove_repeats

    texts, counts, want = [(t or "").encode() for _, t in rows], Counter(), []
    for t in texts:
        counts.update(t[i : i + 200] for i in range(len(t) - 199))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        left = bytes(c for c, g in zip(t, gone) if not g)
        want.append((len(t), sum(gone), len(re.findall(rb"[\x01]+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    got = remove_repeats(docs).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert ordered(got) == ordered(want)
    assert remove_repeats(empty).count() == 0


def components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for a, b in {p for m in by.values() for p in itertools.combinations(m, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_against_brute_force(spark, rows, empty):
    from lodestone.llm.jaccard_join import near_duplicates

    more = rows + [(95000 + i, " ".join(f"w{j}" if j not in (i, i + 30) else f"x{i}_{j}" for j in range(120))) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(more, "doc_id long, text string").repartition(5), 4, 85)
    assert ordered(got.collect()) == ordered(components(more, 4, 85))
    assert near_duplicates(empty).count() == 0


def test_bpe_equals_tiktoken(docs, rows, empty):
    import public_tokenizers as P
    import tiktoken

    from lodestone.llm.byte_bpe import ByteBPE, encode_decode, load_ranks

    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, letters = random.Random(1), "aaaab  \n\t' stlé中 \u0085\x1c.,12　"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["a" * 20000, "ab" * 9999, "thethe" * 4000]
    bpe = ByteBPE(ranks, P.PATTERN)
    for text, (n, ids, raw) in zip(texts, bpe.encode_many(texts)):
        want = ref.encode_ordinary(text)
        assert (n, ids, raw) == (len(want), ",".join(map(str, want)), text.encode())
    assert bpe.decode(bpe.encode("été 12")) == "été 12".encode()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(i), sha(",".join(map(str, i)).encode()), sha((t or "").encode())) for d, t in rows for i in [ref.encode_ordinary(t or "")]]
    got = encode_decode(docs, ranks, P.PATTERN)
    assert ordered(got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == ordered(want)
    assert encode_decode(empty, ranks, P.PATTERN).count() == 0


def test_quality_counts_and_rules(spark, docs, rows, empty):
    from lodestone.llm import quality_rules as q

    want = []
    for d, t in rows:
        raw = (t or "").encode()
        w = WORD.findall(raw)
        c, hit, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
        for i, k in enumerate(zip(w, w[1:], w[2:])):
            if c[k] > 1:
                hit |= {i, i + 1, i + 2}
        for line in raw.split(b"\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        want.append((d, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)))
    assert ordered(q.with_counts(docs).select("doc_id", *q.COUNTS[:5]).collect()) == ordered(want)
    x = {"a": np.arange(300) / 300, "b": np.tile([0.0, 1.0], 150)}
    rules = q.learn(x, (x["a"] > 0.7) & (x["b"] == 1), np.arange(300) // 2)
    assert rules and all(name in x for rule in rules for name, _, _ in rule)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert q.fit(docs.select("doc_id", "text"), labels.limit(0)) == []
    assert q.judge(empty, rules=[]).count() == 0
    assert q.judge(docs.select("doc_id", "text"), []).where("kept AND base_failed").count() == 0


def test_mix_meets_targets(spark, empty):
    from lodestone.llm import mixing as m

    rng = random.Random(3)
    data = [(i, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["b", "b", "b", "c", "a", None])) for i in range(3000)] + [(None, None, "c"), (7, "x y", "zero")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = m.mix(df).cache()
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum("size").alias("size"), F.first("source_size").alias("ss"), F.first("target").alias("t"), F.sum("taken").alias("n")).collect()}
    names = sorted((s for s in by if s is not None), key=str.encode) + [None]
    want = m.targets([by[s]["size"] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert abs(sum(want) - sum(by[s]["size"] for s in names)) < 1e-6
    for s, t in zip(names, want):
        assert by[s]["ss"] == by[s]["size"] and abs(by[s]["t"] - t) < 1e-6 and abs(by[s]["n"] - t) <= 60 and t <= 3 * by[s]["size"]
    assert got.where("taken > 3 * size OR size(positions) <> copies").count() == 0
    again = m.mix(df.repartition(9))
    assert ordered(again.select("doc_id", "size", "taken").collect()) == ordered(got.select("doc_id", "size", "taken").collect())
    order = [r["position"] for r in m.training_order(got).collect()]
    assert order == sorted(order) and m.mix(empty).count() == 0


def test_fingerprints(docs, rows, spark, empty):
    from lodestone.llm.fingerprints import PrefixHashes, compare_with_next, fingerprint, likeness

    rng = random.Random(2)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(2))
        i, j, k = rng.randint(0, len(a)), rng.randint(0, len(b)), 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert PrefixHashes(a).common_extension(i, PrefixHashes(b), j) == k
    plain = [(d, t) for i, (d, t) in enumerate(rows[:200]) if d is not None] + [(9001, None), (9002, "")]
    got = {r["doc_id"]: r for r in compare_with_next(spark.createDataFrame(plain, "doc_id long, text string").repartition(6)).collect()}
    plain.sort(key=lambda r: -r[0])
    for i, (d, t) in enumerate(plain):
        t, after = t or "", plain[(i + 1) % len(plain)][1] or ""
        half = len(t) // 2
        edited = (t[: len(t) - half] + after[:half]).encode()
        mine = fingerprint(t.encode())
        assert (got[d]["n_chars"], got[d]["edited_sha256"], got[d]["fingerprint"]) == (len(t), hashlib.sha256(edited).hexdigest(), mine)
        assert got[d]["near_edited"] == likeness(mine, fingerprint(edited)) and got[d]["near_next"] == likeness(mine, fingerprint(after.encode()))
    assert compare_with_next(docs).count() == len(rows) and compare_with_next(empty).count() == 0


def test_toxicity_held_out(spark, docs, empty, rows):
    from lodestone.llm.toxicity import op1_toxicity, score_texts

    out = op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    hits = (out["predicted"] == 1) & (out["toxic"] == 1)
    assert hits.sum() >= 0.7 * (out["toxic"] == 1).sum() and ((out["predicted"] == 1) & (out["toxic"] == 0)).sum() <= 0.01 * len(out)
    assert out["score"].between(0, 1).all()
    assert score_texts(docs, None).where("score = 0 AND held_out IS NOT NULL").count() == len(rows) and score_texts(empty, None).count() == 0


def test_token_counts_against_plain_search(spark, docs, rows, empty):
    import public_tokenizers as P

    from lodestone.llm.token_counts import MARK, TokenTrie, count_tokens, load_pieces

    scores = load_pieces(P.path("piece_bpe_32k.model"))
    trie = TokenTrie(scores)

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(end):
                piece, last = scores.get(word[start:end]), len(word[start:end].encode())
                if piece is not None:
                    options.append((best[start][0] + piece, -(best[start][1] + 1)))
                elif start == end - 1:
                    options.append((best[start][0] + last * trie.byte, -(best[start][1] + last)))
            top = max(options, key=lambda o: (round(o[0], 7), o[1]))
            best.append((top[0], -top[1]))
        return best[-1][1]

    words = {w.decode() for _, t in rows for w in WORD.findall((t or "").encode())}
    sample = sorted(words)[:1500] + ["中文字", "x" * 300]
    assert [trie.insert(MARK + w) for w in sample] == [plain(MARK + w) for w in sample]
    known = {w: plain(MARK + w) for w in words | {w for w in ("x" * 400).split()}}
    want = [(d, len(w), sum(known[x.decode()] for x in w)) for d, t in rows for w in [WORD.findall((t or "").encode())]]
    assert ordered(count_tokens(docs, scores, keep=["doc_id"]).collect()) == ordered(want) and count_tokens(empty, scores).count() == 0


def test_chat_layouts_and_round_trip(spark):
    from lodestone.llm import chat_format as c

    reg = c.default_registry()
    assert reg.turns({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}) == [("user", "a"), ("assistant", "")]
    assert reg.turns({"instruction": "i", "input": "", "output": "o"}) == [("user", "i"), ("assistant", "o")]
    assert reg.turns({"messages": None}) == reg.turns({"conversations": []}) == []
    odd = [('{"other": 1}', 7), ('{"messages": [{"role": "user", "content": "a"}, {"role": "user", "name": "n", "content": "b"}]}', 7), ("{}", 7), ("no json", 7), (None, 7), ('{"messages": null}', 7), ('{"question": "q<", "answer": "a"}', 7)]
    out = c.format_records(spark.createDataFrame(odd, "record string, problem int"), reg).collect()
    assert [r["problem"] is None for r in out] == [False, False, False, False, True, True, True]
    assert c.parse(out[6]["formatted"]) == [("user", "q<"), ("assistant", "a")] and out[5]["formatted"] == "" and "no mapping" in out[0]["problem"]
    samples = [{"prompt": "p", "response": "r"}, {"prompt": "p", "completion": "r"}, {"question": "p", "answer": "r"}, {"instruction": "p", "output": "r"}, {"instruction": "p", "input": "", "output": "r"}]
    samples += [{"instruction": "p", "context": "", "response": "r", "category": "x"}, {"prompt": {"system": "", "user": "p"}, "response": "r"}, {"id": "1", "conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r"}]}]
    samples += [{"id": 1, "messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}]}, {"messages": [{"role": "user", "text": "p"}, {"role": "assistant", "text": "r"}]}, {"system": "", "conversations": [{"from": "human", "value": "p"}, {"from": "bot", "value": "r"}]}]
    assert len({c.fingerprint(s) for s in samples}) == len(samples) and all(reg.turns(s) == [("user", "p"), ("assistant", "r")] for s in samples)
    turns = [("user", "</s>[INST] <|end|>\n &lt; &amp;lt; &#91;"), ("odd\nrole", ""), ("assistant", "<|turn|>é")]
    text, spans = c.render(turns)
    assert c.parse(text) == turns and [c.unescape(text[a:b]) for a, b in spans] == ["<|turn|>é"]
    df = spark.createDataFrame([(1, None, "user", None), (1, 2, None, "x"), (None, 1, "assistant", "y"), (1, 2, None, "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in c.read_back(c.format_records(c.as_records(df), reg)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 1
    assert c.as_records(df.limit(0)).count() == 0
    many = spark.range(200).select(F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("a").alias("text"))
    many = many.unionByName(many.withColumns({"turn": F.lit(2).cast("long"), "role": F.lit("assistant")}))
    import json

    assert len({c.fingerprint(json.loads(r["record"])) for r in c.as_records(many).collect()}) == 4  # the query's records have four layouts


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op4_chat_format", "op8_jaccard_join"])
def test_queries_against_sql(spark, name):
    import duckdb

    from lodestone.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(got.select(*want.columns).collect()) == ordered(want.fetchall())


def test_token_shards(spark, docs, rows, empty, tmp_path):
    import public_tokenizers as P

    from lodestone.llm.byte_bpe import load_ranks
    from lodestone.llm.common import materialize
    from lodestone.llm.token_shards import feistel, read_slots, tokenise, training_rows, write_shards

    for n in (1, 2, 3, 100, 4097):
        assert sorted(feistel(np.arange(n), n).tolist()) == list(range(n))
    ranks = load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    tokens = materialize(tokenise(docs, ranks, P.PATTERN, 50256), "tokens")
    out = training_rows(tokens, length=64, shard_rows=100, pad=50256)
    found = out.orderBy("slot").collect()
    parts = tokens.orderBy("file", "first", "start").collect()
    stream = b"".join(r["ids"] for r in parts)
    assert [r["slot"] for r in found] == list(range(-(-len(stream) // 128)))
    for r in found:
        piece = stream[128 * r["sequence"] : 128 * (r["sequence"] + 1)]
        assert r["ids"][: len(piece)] == piece and len(r["ids"]) == 128 and r["n_tokens"] == len(piece) // 2
    write_shards(out, str(tmp_path)).collect()
    assert all(a.tobytes() == r["ids"] for a, r in zip(read_slots(str(tmp_path), 95, 20, 64, 100), found[95:115]))
    assert training_rows(materialize(tokenise(empty, ranks, P.PATTERN, 50256), "none")).count() == 0


def test_pipeline_stages_against_brute_force(spark, empty):
    import corpus_pipeline as cp
    from lodestone.llm import pipeline_stages as st

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    good = cp.materialize(st.quality_stage(spark, docs, SF), "a")
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    one = cp.materialize(st.near_duplicate_stage(spark, good, SF), "b")
    kept = {d for d, _, c in components([(r["doc_id"], r["text"]) for r in good.collect()], 5, 80) if d == c}
    assert {r["doc_id"] for r in one.collect()} == kept and one.count() == len(kept)
    cut = cp.materialize(st.repeated_text_stage(spark, one, SF), "c")
    assert cut.where("n_chars <> char_length(text)").count() == 0 and cut.count() <= one.count()
    mixed = st.mixing_stage(spark, cut, SF)
    assert mixed.columns == docs.columns and mixed.join(cut, "doc_id", "left_anti").count() == 0
    for _, stage in cp.STAGES[1:4]:
        assert stage(spark, empty, SF).count() == 0
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "repeated_text", "source_mix", "byte_bpe"]
