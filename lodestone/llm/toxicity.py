"""Operator 1: toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, give a word's bytes one by one from at most ORDER - 1 bytes before
them within the word. Each interpolates its own discounted counts with one shared backoff: Kneser-Ney
continuation counts pooled over both classes, so an expression that is rare in one class is judged
by what both have seen and only contexts that really differ speak. A word's log-likelihood ratio is
the sum over its bytes, and its peak the greatest sum over SPAN of them in a row (over all, where it
has fewer): one rule for words of every length, so that an expression within a text without spaces
weighs what it weighs elsewhere. A text is scored by its ratio normalised by length - over all its
bytes - and by its most telling peaks, through a logistic calibration. The calibration sees each
fitting text scored by models that were fitted without it (FOLDS parts), and is moved so that CUT is
where these texts' classes are told apart best: by the F measure in which precision counts double.

Fit: labelled rows whose crc32(doc_id as text) mod 3 isn't 1, at most FIT_TOXIC toxic and
FIT_ORDINARY ordinary ones (those with the least hash of doc_id): a documented bound. Where labels
disagree, toxic wins; null labels don't count. If one class has no row, every score is 0.

Rows: null and empty texts have no words and get the calibration's score for that, capped below
0.5. Labels, language, source and doc_id are never inputs of a score. A null doc_id is not held
out. Very long texts and words are read whole. Ties among labelled rows at the bound go by doc_id. Extra columns are carried,
clashing ones replaced. Repeated rows score alike; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches, table, texts

ORDER = 6
#: Absolute discount of the shared continuation counts, and those tried for a class's own counts: the one under which
#: fitting texts, each scored by models that were fitted without it, have the least log loss.
DISCOUNT = 0.75
CLASS_DISCOUNTS = (0.75, 1.5, 3.0)
FOLDS = 3
FIT_TOXIC = 2_500
FIT_ORDINARY = 5_000
CUT = 0.7
CACHE_ENTRIES = 400_000
#: Words of more bytes aren't kept between batches; their scores are the same.
LONG = 64
#: Bytes in a row whose ratios make a peak.
SPAN = 16
_EDGES = b".,;:!?\"'()[]{}*#$%&|<>-"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def events(words: list[bytes], block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, place in the word, key) of each byte event of the words, their end included, about `block` bytes at a time.

    A key packs the context and the byte. A long word may go on in the next block, with its context.
    """
    marked = [b"\x02" + w + b"\x03" for w in words]
    whole = np.frombuffer(b"".join(marked), np.uint8)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    del marked
    ends = np.cumsum(sizes)
    begins = ends - sizes
    for a in range(0, len(whole), block):
        low, high = max(0, a - ORDER + 1), min(a + block, len(whole))
        data = whole[low:high].astype(np.int64)
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(begins, high, "left")
        here = np.minimum(ends[first:last], high) - np.maximum(begins[first:last], low)
        owner = np.repeat(np.arange(first, last), here)
        place = np.arange(low, high) - begins[owner]
        key = data.copy()
        for k in range(1, ORDER):
            back = np.zeros_like(data)
            back[k:] = data[:-k]
            key |= np.where(place >= k, back, 0) << (8 * k)
        keep = place > 0
        keep[: a - low] = False
        yield owner[keep], place[keep] - 1, key[keep]


def _plain(word: bytes) -> bytes:
    return word.strip(_EDGES) or word


class Model:
    """What scoring needs: the ratio of each seen event, and of leaving each seen context."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, discount: float = CLASS_DISCOUNTS[0], shared: np.ndarray | None = None) -> None:
        """Distinct event keys with their counts in either class; shared: the keys' backoff, where it is known."""
        shared = _shared_backoff(keys) if shared is None else shared
        p, leave = [], []
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        for count in (toxic, ordinary):
            total = np.bincount(of, count, len(contexts))
            freed = np.bincount(of, np.minimum(count, discount), len(contexts))
            rest = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
            own = np.where(total[of] > 0, np.maximum(count - discount, 0) / np.maximum(total[of], 1), 0.0)
            p.append(own + rest[of] * shared)
            leave.append(rest)
        self.keys, self.seen = keys, np.log(p[0] / p[1])
        self.contexts, self.left = contexts, np.log(leave[0] / leave[1])

    def ratios(self, words: list[bytes]) -> np.ndarray:
        """Of each word: its ratio, its events (bytes and end), its peak."""
        out = np.zeros((len(words), 3))
        if not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        out[:, 1], out[:, 2] = sizes, -np.inf
        before = np.zeros(0)  # the last word's values in the block before
        for owner, place, key in events(words):
            if not len(owner):
                continue
            distinct, back = np.unique(key, return_inverse=True)
            got = np.zeros(len(distinct))
            at = np.minimum(np.searchsorted(self.contexts, distinct >> 8), len(self.contexts) - 1)
            hit = self.contexts[at] == distinct >> 8
            got[hit] = self.left[at[hit]]
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            hit = self.keys[at] == distinct
            got[hit] = self.seen[at[hit]]
            values = got[back]
            part = np.bincount(owner - owner[0], values)
            out[owner[0] : owner[0] + len(part), 0] += part
            near = np.concatenate((before, values))
            spans = values.copy()
            for k in range(1, min(SPAN, len(near))):
                there = np.zeros(len(values))
                there[max(0, k - len(before)) :] = near[max(0, len(before) - k) : len(near) - k]
                spans += np.where(place >= k, there, 0)
            full = (place >= SPAN - 1) | (place == sizes[owner] - 1)
            np.maximum.at(out[:, 2], owner[full], spans[full])
            before = near[-min(SPAN - 1, int(place[-1]) + 1) :]
        return out


def _shared_backoff(keys: np.ndarray) -> np.ndarray:
    """P(byte | all but the farthest byte of the context), pooled Kneser-Ney, for each distinct event."""
    alphabet = 1 / 256
    # levels[j]: events without their j farthest bytes
    shorter, now = [], keys
    for _ in range(ORDER - 1):
        top = np.zeros(len(now), np.int64)
        for k in range(1, ORDER):
            top = np.where((now >> (8 * k)) > 0, 8 * k, top)
        now = np.where(top > 0, now & ((np.int64(1) << top) - 1), now)
        shorter.append(now)
    out = np.full(len(keys), alphabet)
    spread = [*reversed(list(enumerate(shorter)))]
    for j, level in spread:
        before = keys if j == 0 else shorter[j - 1]
        pairs = np.unique(np.stack((level, before)), axis=1)  # distinct continuations of each shorter event
        events_, counts = np.unique(pairs[0], return_counts=True)
        contexts, of = np.unique(events_ >> 8, return_inverse=True)
        total = np.bincount(of, counts, len(contexts))
        kinds = np.bincount(of, minlength=len(contexts))
        at = np.searchsorted(events_, level)
        where = of[at]
        out = np.maximum(counts[at] - DISCOUNT, 0) / total[where] + DISCOUNT * kinds[where] / total[where] * out
    return out


class Scorer:
    """Scores words with several models at once and keeps what it has scored."""

    def __init__(self, models: list[Model]) -> None:
        self.models, self.ids, self.table = models, {}, np.zeros((0, len(models), 3))

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all words by model, offsets of each text's words)."""
        raw, words, ends = data.tobytes().lower(), [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words += raw[a:b].split()
            ends.append(len(words))
        fresh = list(set(words).difference(self.ids))
        if fresh:
            if len(self.table) + len(fresh) > CACHE_ENTRIES:
                self.ids, self.table, fresh = {}, self.table[:0], list(set(words))
            plain = [_plain(w) for w in fresh]
            self.ids.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh)), strict=True))
            self.table = np.concatenate((self.table, np.stack([m.ratios(plain) for m in self.models], axis=1)))
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        for w in fresh:
            if len(w) > LONG:
                del self.ids[w]
        return self.table[at], np.array(ends)


def features(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each text: mean ratio a byte; the greatest peak, and the mean of the three greatest; log length."""
    out = np.zeros((len(ends) - 1, 4))
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if b > a:
            total, size = values[a:b, 0].sum(), values[a:b, 1].sum()
            v = values[a:b, 2]
            top = np.partition(v, len(v) - 3)[-3:] if len(v) > 3 else v
            out[i] = total / size, top.max(), np.maximum(top, 0).mean(), np.log1p(size)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the constant last) by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic and fold of at most FIT_TOXIC + FIT_ORDINARY rows."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit(1), F.col("doc_id")), F.col("doc_id")]
    chosen = marked.where("toxic = 1").orderBy(*order).limit(FIT_TOXIC).unionByName(marked.where("toxic <> 1").orderBy(*order).limit(FIT_ORDINARY))
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64(F.lit(2), F.col("doc_id")), F.lit(FOLDS)).cast("int"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by the two limits


def _count_rows(words: list[bytes], times: np.ndarray, toxic: int, fold: int) -> Iterator[pa.RecordBatch]:
    for owner, _, key in events(words):
        keys, of = np.unique(key, return_inverse=True)
        n = np.bincount(of, times[owner], len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), toxic, np.int32)), pa.array(np.full(len(keys), fold, np.int32)), pa.array(n)], names=["key", "toxic", "fold", "n"])


def _event_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each byte event by class and fold; short words are summed up within a task."""
    counts: dict[tuple[int, int], Counter] = {}
    for rows, data, offsets in pieces(batches, "text"):
        raw, long = data.tobytes().lower(), {}
        for a, b, t, fold in zip(offsets[:-1].tolist(), offsets[1:].tolist(), rows.column("toxic").to_pylist(), rows.column("fold").to_pylist(), strict=True):
            words = raw[a:b].split()
            counts.setdefault((int(t == 1), fold), Counter()).update(_plain(w) for w in words if len(w) <= LONG)
            long.setdefault((int(t == 1), fold), []).extend(_plain(w) for w in words if len(w) > LONG)
        for (toxic, fold), words in long.items():
            yield from _count_rows(words, np.ones(len(words)), toxic, fold)
    for (toxic, fold), words in counts.items():
        yield from _count_rows(list(words), np.fromiter(words.values(), float, len(words)), toxic, fold)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, tuple] | None:
    """The final models and calibration, or None if a class is missing."""
    small_batches(docs.sparkSession)
    sample = _sample(docs, labels)
    parts = [F.sum(F.when((F.col("toxic") == c) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{c}{f}") for c in (0, 1) for f in range(FOLDS)]
    counted = sample.mapInArrow(_event_counts, "key long, toxic int, fold int, n long").groupBy("key").agg(*parts).toArrow()  # a row for each event of the bounded sample
    keys = counted.column("key").to_numpy()
    order = np.argsort(keys)
    keys, by = keys[order], np.stack([c.to_numpy()[order] for c in counted.columns[1:]]).reshape(2, FOLDS, -1)
    del counted
    if not by[0].any() or not by[1].any():
        return None
    counts = []
    for f in range(FOLDS):
        rest = [g for g in range(FOLDS) if g != f]
        t, o = by[1, rest].sum(0), by[0, rest].sum(0)
        use = (t + o) > 0 if ((t + o) > 0).any() else np.ones(len(keys), bool)
        counts.append((keys[use], t[use], o[use]))
    backoffs = [_shared_backoff(k) for k, _, _ in counts]
    best = None
    for discount in CLASS_DISCOUNTS:
        x, y = _apart(sample, [Model(*c, discount, b) for c, b in zip(counts, backoffs, strict=True)])
        if not len(y) or y.min() == y.max():
            return None
        calibrated = _logistic(x, y)
        loss = _log_loss(x, y, calibrated)
        if best is None or loss < best[0]:
            best = (loss, discount, calibrated, x)
    mean, scale, w = best[2]
    w[-1] += np.log(CUT / (1 - CUT)) - _divide((best[3] - mean) / scale @ w[:-1] + w[-1], y)
    return Model(keys, by[1].sum(0), by[0].sum(0), best[1]), (mean, scale, w)


def _divide(z: np.ndarray, y: np.ndarray, beta: float = 0.5) -> float:
    """The value from which on to say 1, so that F-beta is greatest: amid two neighbours, the highest of equal ones."""
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(y[order])
    said = np.arange(1, len(z) + 1)
    f = (1 + beta**2) * hits / (said + beta**2 * y.sum())
    ends = np.append(z[:-1] > z[1:], False)  # a cut can't part equal values
    if not ends.any():
        return float(z[0])
    k = int(np.argmax(np.where(ends, f, -1)))
    return float(z[k] + z[k + 1]) / 2


def _log_loss(x: np.ndarray, y: np.ndarray, calibrated: tuple) -> float:
    mean, scale, w = calibrated
    z = np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)
    return float(np.mean(np.log1p(np.exp(z)) - y * z))


def _apart(sample: DataFrame, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of the fitting texts, each by the model of its fold, in one order whatever the partitions."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for rows, data, offsets in pieces(batches, "text"):
            ratios, ends = scorer.texts(data, offsets)
            all_x = [features(ratios[:, f], ends) for f in range(FOLDS)]
            x = np.stack([all_x[f][i] for i, f in enumerate(rows.column("fold").to_pylist())])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), *[pa.array(x[:, k]) for k in range(4)]], names=["doc_id", "toxic", "x0", "x1", "x2", "x3"])

    found: pd.DataFrame = sample.mapInArrow(score, "doc_id long, toxic int, x0 double, x1 double, x2 double, x3 double").toArrow().to_pandas().sort_values(["doc_id", "x0", "x1", "x2", "x3"])
    shared.destroy()
    return found[["x0", "x1", "x2", "x3"]].to_numpy(), (found["toxic"] == 1).to_numpy(float)


def score_texts(docs: DataFrame, model: tuple[Model, tuple] | None) -> DataFrame:
    """Every row of docs (without its text) with held_out, score and predicted."""
    small_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    rest = [f for f in docs.schema.fields if f.name != "text"]
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    if model is None:
        return docs.drop("text").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop("text").schema.add("score", "double").add("predicted", "integer")
    names = [*[f.name for f in rest], "held_out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 50, 1000)
        final, (mean, scale, w) = shared.value
        scorer = Scorer([final])
        for rows, data, offsets in pieces(batches, "text"):
            ratios, ends = scorer.texts(data, offsets)
            x = features(ratios[:, 0], ends)
            s = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))
            s = np.where(np.diff(ends) == 0, np.minimum(s, 0.49), s)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text")
    return score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
