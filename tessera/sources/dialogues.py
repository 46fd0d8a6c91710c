"""Split datasets of (dialogue, summary): from conversation turns, and from and to Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.indexing import dense_index
from .schemas import RAW


def split_of(conv_id: Column) -> Column:
    return F.when(F.pmod(conv_id, F.lit(10)) < 8, "train").when(F.pmod(conv_id, F.lit(10)) == 8, "validation").otherwise("test")


def assemble(conversations: DataFrame) -> DataFrame:
    """(conv_id, split, dialogue, summary): the last turn is the summary, those before it the dialogue, as ``role: text`` lines. Conversations of one turn are left out."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    whole = conversations.groupBy("conv_id").agg(turns).where(F.size("turns") >= 2)
    lines = F.transform(F.slice("turns", 1, F.size("turns") - 1), lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return whole.select("conv_id", split_of(F.col("conv_id")).alias("split"), F.array_join(lines, "\n").alias("dialogue"), F.element_at("turns", -1)["text"].alias("summary"))


def dataset(conversations: DataFrame) -> DataFrame:
    """(split, row_idx, conv_id, dialogue, summary), rows in order of conv_id within their split."""
    return dense_index(assemble(conversations), ["conv_id"], ["split"], "row_idx")


def read_dataset(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """A stored dataset, all splits; a split is a pruned filter on ``split``."""
    return spark.read.schema(schema).parquet(path)


def write_dataset(df: DataFrame, path: str) -> None:
    """All columns of all splits, a folder for each split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
