"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, partitions, shared_dir

__all__ = ["cut", "cut_small", "freed", "join_sums", "partitions", "shared_dir", "table"]

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_small(df: DataFrame, rows: int, each: int) -> DataFrame:
    """As :func:`cut`, for a table of about ``rows`` rows: a file for each ``each`` of them, and no more files than ``df`` has partitions.

    Adaptive execution merges small partitions too, but not where that is off or the partitions' number was asked for.
    """
    return cut(df.coalesce(max(1, -(-rows // each))))


def join_sums(rows: DataFrame, sums: DataFrame, on: list[str], hint: str | None = None) -> DataFrame:
    """``rows`` joined with ``sums``, an aggregate that has a row for each value of ``on``, so that the rows of a frequent value may be several tasks'.

    Adaptive execution parts a frequent value only where both sides come straight from an exchange.
    An aggregate by the same columns needs none, so a further column, which follows from them, makes it have one.
    """
    by = (F.xxhash64(*on) == 0).alias("_side")
    right = sums.select("*", by)
    return rows.select("*", by).join(right.hint(hint) if hint else right, [*on, "_side"]).drop("_side")


def give_back() -> None:
    """Returns to the system what this process has freed; allocators keep most of it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def freed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, after whose last batch the worker gives its freed memory back.

    Workers stay for the tasks that follow, of whatever stage, and count as their executor's memory
    while they wait or do smaller work.
    """

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return wrapped
