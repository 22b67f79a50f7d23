"""Operator 5: quality rules as a learned decision list.

Statistics of each text are counted in one Arrow pass. From labelled rows, sequential covering
learns an ordered list of rules for the low-quality class: a rule grows by the threshold that gains
most (FOIL's gain) on two thirds of the rows, is pruned on the last third, and is kept only if it is
precise there; the rows it covers leave and the next rule is grown. The list becomes one ordered
Spark conditional expression, so scoring is JVM code.

Growing tries every threshold between two values of each statistic. A list has at most 12 rules of at
most 4 tests each: a documented bound.

Fit: at most FIT_ROWS labelled rows (those with the least hash of doc_id), a documented bound; a
document with several labels counts as low quality if any says so, null labels don't count. With
no low-quality row the list is empty and everything that passes the base rules is kept.

Rows: null text counts as empty and fails the base rules (fewer than MIN_WORDS words). Nulls in
other columns, repeated rows and clashing extra columns make no difference; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, mix, pieces, small_batches, span_hashes, table, texts, words_of

FIT_ROWS = 20_000
MIN_WORDS = 50
_U = np.uint64

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines", "n_distinct_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?;:=_~^")] = True

#: Ratios that rules may test: name, counted column, its denominator.
RATIOS = [
    ("symbols_per_word", "n_symbols", "n_words"), ("repeats_per_word", "n_repeat_words", "n_words"), ("dup_lines_per_line", "n_dup_lines", "n_lines"),
    ("upper_per_char", "n_upper", "word_chars"), ("marks_per_word", "n_marks", "n_words"), ("digits_per_char", "n_digits", "word_chars"),
    ("chars_per_word", "word_chars", "n_words"), ("words_per_line", "n_words", "n_lines"), ("distinct_per_word", "n_distinct_words", "n_words"),
]


def _repeats(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value is met twice or more in its row, whether an equal one stands before it)."""
    order = np.lexsort((np.arange(len(row)), hashes, row))
    r, h = row[order], hashes[order]
    same = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    often, later = np.zeros(len(row), bool), np.zeros(len(row), bool)
    often[order[1:]] |= same
    often[order[:-1]] |= same
    later[order[1:]] = same
    return often, later


def text_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text."""
    n = len(offsets) - 1

    def flagged(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[offsets[1:]] - total[offsets[:-1]]

    start, end, row = words_of(data, offsets)
    word = span_hashes(data, start, end)
    n_words = np.bincount(row, minlength=n)
    repeated = np.zeros(n, np.int64)
    if len(row) >= 3:
        inside = np.flatnonzero(row[2:] == row[:-2])
        three = mix(mix(word[inside] * _U(3) + word[inside + 1]) * _U(5) + word[inside + 2])
        often, _ = _repeats(row[inside], three)
        hit = np.zeros(len(row), bool)
        for k in range(3):
            hit[inside[often] + k] = True
        repeated = np.bincount(row[hit], minlength=n)
    _, again = _repeats(row, word) if len(row) else (None, np.zeros(0, bool))
    # lines: cut at \n and at the ends of texts
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[line_row + 1])
    line_end = line_end - ((line_end > line_start) & (data[line_end - 1] == 10)) if len(line_start) else line_end
    solid = np.concatenate(([0], np.cumsum(~_SPACE[data])))
    full = solid[line_end] > solid[line_start] if len(line_start) else np.zeros(0, bool)
    lr, lh = line_row[full], span_hashes(data, line_start[full], line_end[full])
    _, dup = _repeats(lr, lh) if len(lr) else (None, np.zeros(0, bool))
    head = (data & 0xC0) != 0x80
    return [
        n_words, flagged(~_SPACE[data] & head), flagged(_SYMBOL[data]), np.bincount(lr[dup], minlength=n), repeated,
        flagged(_UPPER[data]), flagged(_MARK[data]), flagged(_DIGIT[data]), np.bincount(lr, minlength=n), n_words - np.bincount(row[again], minlength=n),
    ]


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with COUNTS as long columns; input columns of these names are replaced."""
    small_batches(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name not in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, text, 1 << 20):
            counts = [pa.array(c.astype(np.int64)) for c in text_counts(data, offsets)]
            yield pa.RecordBatch.from_arrays([rows.column(f.name) for f in fields] + counts, names=[f.name for f in fields] + COUNTS)

    return df.select(*[f"`{f.name}`" for f in fields]).mapInArrow(run, T.StructType(fields + [T.StructField(c, T.LongType()) for c in COUNTS]))


def base_failed() -> Column:
    """Fixed rule: fewer than 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


# --- learning -------------------------------------------------------------------------------------

Rule = list[tuple[str, str, float]]


def ratio_columns() -> dict[str, Column]:
    return {name: F.col(a) / F.greatest(F.col(b), F.lit(1)) for name, a, b in RATIOS}


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, op, at in rule:
        out &= x[name] >= at if op == ">=" else x[name] <= at
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, longest: int) -> Rule:
    rule: Rule = []
    live = np.ones(len(y), bool)
    while len(rule) < longest and (live & ~y).any():
        p0, n0 = (live & y).sum(), (live & ~y).sum()
        best = (0.0, None)
        for name, values in x.items():
            v, t = values[live], y[live]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            low = np.concatenate(([0], np.cumsum(t)))[cut]
            for op, p, n in ((">=", p0 - low, n0 - (cut - low)), ("<=", low, cut - low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                gain = np.where(p > 0, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, op, float((v[cut[k] - 1] + v[cut[k]]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _covers([best[1]], x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """The prefix of the rule with the best (p - n) / (p + n) on held-back rows, the shortest on ties."""
    best: tuple[float, Rule] = (-2.0, [])
    for k in range(1, len(rule) + 1):
        hit = _covers(rule[:k], x)
        p, n = (hit & y).sum(), (hit & ~y).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, rule[:k])
    return best[1]


def learn(x: dict[str, np.ndarray], low: np.ndarray, order: np.ndarray, precision: float = 0.9, longest: int = 4, rules: int = 12) -> list[Rule]:
    """Ordered rules for low-quality rows. order: a number for each row that fixes growing (two thirds) and pruning rows."""
    grown = order % 3 != 0
    out: list[Rule] = []
    left = np.ones(len(low), bool)
    for _ in range(rules):
        g, h = left & grown, left & ~grown
        if (low & g).sum() < 3 or not (low & h).any():
            break
        rule = _prune(_grow({k: v[g] for k, v in x.items()}, low[g], longest), {k: v[h] for k, v in x.items()}, low[h])
        if not rule:
            break
        hit = _covers(rule, x)
        p, n = (hit & h & low).sum(), (hit & h & ~low).sum()
        if not p or p / (p + n) < precision:
            break
        out.append(rule)
        left &= ~hit
    return out


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression: true where a text is kept."""
    ratios, out = ratio_columns(), None
    for rule in rules:
        test = F.lit(True)
        for name, op, at in rule:
            test = test & (ratios[name] >= at if op == ">=" else ratios[name] <= at)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Learns from the labelled texts that pass the base rules."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` ids
    counts = with_counts(sample).where(~base_failed()).select("doc_id", "quality", *[c.alias(k) for k, c in ratio_columns().items()]).toPandas()
    counts = counts.sort_values(["doc_id", *[r[0] for r in RATIOS]])
    if not len(counts):
        return []
    x = {name: counts[name].to_numpy(float) for name, _, _ in RATIOS}
    spread = mix(counts["doc_id"].to_numpy(np.int64).astype(_U))
    return learn(x, (counts["quality"] == 0).to_numpy(), (spread >> _U(8)).astype(np.int64))


def judge(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with COUNTS, base_failed and kept."""
    return with_counts(df).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text")
    small_batches(spark)
    scored = judge(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", *COUNTS[:5], "base_failed", "kept")
