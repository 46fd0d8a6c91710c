"""Selecting splits, rows and columns, counts, and batches by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` stored rows of each split: a filter on their position, no sort."""
    return df.where(F.col("row_idx") < n)


def row(df: DataFrame, i: int) -> DataFrame:
    return df.where(F.col("row_idx") == i)


def pair(df: DataFrame, text: str = "article", summary: str = "highlights") -> DataFrame:
    """Text and summary columns of any names as (split, row_idx, text, summary)."""
    return df.select("split", "row_idx", F.col(text).alias("text"), F.col(summary).alias("summary"))


def zip_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of equal position side by side, as far as both go."""
    return left.join(right, ["split", "row_idx"])


def model_inputs(df: DataFrame) -> DataFrame:
    return df.select("input_ids", "attention_mask", "labels")


def counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def batches(df: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """(split, batch_id, n, columns as arrays by position): ``size`` rows each, the last of a split maybe fewer."""
    grouped = df.groupBy("split", F.floor(F.col("row_idx") / size).alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct("row_idx", *columns))).alias("rows"))
    return grouped.select("split", "batch_id", F.size("rows").cast("long").alias("n"), *[F.col(f"rows.{c}").alias(c) for c in columns])


def batch_counts(df: DataFrame, size: int) -> DataFrame:
    return df.groupBy("split").agg(F.ceil(F.count("*") / size).alias("batches"))
