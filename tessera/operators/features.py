"""Token features by a vocabulary of whitespace words, as expressions and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import EOS, LABEL_PAD, PAD, UNKNOWN, mask, pad, padded_mask, truncate
from ..functions.text import clean_spacing, space_tokens
from .indexing import dense_index

FIRST_ID = 3


def vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(token, id): distinct words of the columns in order, ids from FIRST_ID."""
    words = df.select(F.explode(F.concat(*[space_tokens(F.col(c)) for c in columns])).alias("token")).distinct()
    return dense_index(words.withColumn("_all", F.lit(0)), ["token"], ["_all"], "id").select("token", (F.col("id") + FIRST_ID).cast("int").alias("id"))


def encode(df: DataFrame, text: str, ids: str, vocab: DataFrame, cap: int, eos: int | None = EOS) -> DataFrame:
    """``df`` (keyed by split and row_idx) with ``ids``: at most ``cap`` of its words' ids, ``eos`` last within the cap.

    Words beyond the cap are cut off before any is looked up; unknown words get UNKNOWN.
    """
    words = F.slice(space_tokens(F.col(text)), 1, cap if eos is None else cap - 1)
    each = df.select("split", "row_idx", F.posexplode(words).alias("_at", "token"))
    known = each.join(vocab, "token", "left").select("split", "row_idx", "_at", F.coalesce("id", F.lit(UNKNOWN)).alias("id"))
    own = known.groupBy("split", "row_idx").agg(F.array_sort(F.collect_list(F.struct("_at", "id"))).alias("_x"))
    found = F.coalesce(F.col("_x.id"), F.array().cast("array<int>"))
    return df.join(own, ["split", "row_idx"], "left").withColumn(ids, truncate(found, cap, eos)).drop("_x")


def features(df: DataFrame, vocab: DataFrame, text: str = "dialogue", summary: str = "summary", max_source: int = 1024, max_target: int = 128) -> DataFrame:
    """``df`` and input_ids, attention_mask and labels, none of them padded."""
    both = encode(encode(df, text, "input_ids", vocab, max_source), summary, "labels", vocab, max_target)
    return both.withColumn("attention_mask", mask(F.col("input_ids")))


def padded(df: DataFrame, size: int = 1024) -> DataFrame:
    """input_ids and attention_mask at a fixed length."""
    return df.withColumn("attention_mask", padded_mask(F.col("input_ids"), size)).withColumn("input_ids", pad(F.col("input_ids"), size, PAD))


def collated(df: DataFrame, batch: int) -> DataFrame:
    """Batches of consecutive rows padded to their longest; labels with LABEL_PAD, which losses skip."""
    own = df.withColumn("batch_id", F.floor(F.col("row_idx") / batch))
    of = Window.partitionBy("split", "batch_id")
    own = own.withColumn("_n", F.max(F.size("input_ids")).over(of)).withColumn("_m", F.max(F.size("labels")).over(of))
    masked = own.withColumn("attention_mask", padded_mask(F.col("input_ids"), F.col("_n")))
    return masked.withColumn("input_ids", pad(F.col("input_ids"), F.col("_n"), PAD)).withColumn("labels", pad(F.col("labels"), F.col("_m"), LABEL_PAD)).drop("_n", "_m")


def decode(df: DataFrame, ids: str, vocab: DataFrame, text: str = "text") -> DataFrame:
    """(split, row_idx, text): the words of ``ids`` without special ones, spacing cleaned up."""
    each = df.select("split", "row_idx", F.posexplode_outer(ids).alias("_at", "id")).join(vocab, "id", "left")
    words = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("_at", "token")))).alias("_x")
    return each.groupBy("split", "row_idx").agg(words).select("split", "row_idx", clean_spacing(F.array_join("_x.token", " ")).alias(text))
