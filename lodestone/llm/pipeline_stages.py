"""The corpus pipeline's stages: each takes (spark, docs, sf_dir), each but the last returns documents' columns.

Rows, in every stage: null text counts as empty, texts of any length are read whole, nulls in other columns are
carried, columns beyond those of documents are left out, and an empty table gives an empty one.

* quality: a text of fewer than 50 words, so also an empty or null one, goes; repeated rows fare alike.
* near duplicates: of repeated rows one stays, and of a group the least doc_id (null last, then by the text's hash); texts
  without words link with nothing and all stay.
* repeated text: repeated rows are copies and lose all; a text of which no word is left goes unless it lost nothing.
* mix: rows without words are not taken; ties of id go by the text's hash, rows equal in both are rows of their own.
* encoding: an empty text has no token; repeated rows are encoded alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, jaccard_join, mixing, quality_rules, suffix_dedup
from .common import materialize, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Entries of the encoder's caches here: its workers go on to hold the other stages' data, and caches outlive a stage.
CACHED = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base rules and the learned decision list keep."""
    docs = docs.select(*COLUMNS)
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the least doc_id (five words, 0.8)."""
    docs = docs.select(*COLUMNS)
    rows, found = jaccard_join.similar_components(docs, 5, 80)
    group = F.coalesce("component", "node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key")).alias("one")
    stay = rows.where("n > 0").join(found, "node", "left").groupBy(group.alias("g")).agg(first).select("one.doc_id", "one.key")
    stay = materialize(stay.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")), "stay")
    keyed = docs.withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    on = (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    kept = keyed.join(stay, on, "left_semi").dropDuplicates(["_key", "doc_id"]).drop("_key")
    empty = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.unionByName(empty).select(*COLUMNS)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes that occur twice or more; a document of which nothing is left goes."""
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), keep=["doc_id", "lang", "source"], as_text=True)
    kept = cut.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row for each copy taken, range-sorted by position."""
    return mixing.training_order(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    import public_tokenizers as P

    small_batches(spark)
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode_decode(docs.select("doc_id", "source", "text"), ranks, P.PATTERN, entries=CACHED).drop("text")
