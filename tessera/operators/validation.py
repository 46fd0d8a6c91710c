"""Whether a dataset folder holds what it should."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unexpected(entries: DataFrame, required: list[str]) -> DataFrame:
    return entries.where(~F.col("name").isin(required))


def missing(entries: DataFrame, required: list[str]) -> DataFrame:
    wanted = entries.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, required))).alias("name"))
    return wanted.join(entries, "name", "left_anti")


def status_compat(entries: DataFrame, required: list[str]) -> DataFrame:
    """(status): whether the last entry by ``ord`` is a required one; null without entries."""
    return entries.agg(F.max_by(F.col("name").isin(required), "ord").alias("status"))


def status_strict(entries: DataFrame, required: list[str]) -> DataFrame:
    """(status): whether the entries are the required ones, none missing and none more; null without entries."""
    wanted = F.col("name").isin(required)
    known = F.count_distinct(F.when(wanted, F.col("name")))
    return entries.agg(F.when(F.count("*") > 0, (known == len(set(required))) & (F.count_if(~wanted) == 0)).alias("status"))


def status_text(status: bool | None) -> str | None:
    """What the status file holds; None (no file) for a null status."""
    return None if status is None else f"Validation status: {status}"
