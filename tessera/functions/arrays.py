"""Token arrays: caps, masks and padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, EOS, UNKNOWN, LABEL_PAD = 0, 1, 2, -100


def truncate(ids: Column, cap: int, eos: int | None = None) -> Column:
    """The first ``cap`` ids; with ``eos`` that ends them, within the cap."""
    if eos is None:
        return F.slice(ids, 1, cap)
    return F.concat(F.slice(ids, 1, cap - 1), F.array(F.lit(eos)))


def mask(ids: Column) -> Column:
    """A 1 for each id."""
    return F.transform(ids, lambda x: F.lit(1))


def pad(ids: Column, size: Column | int, value: int = PAD) -> Column:
    """``ids`` cut or filled up with ``value`` to ``size``."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(F.slice(ids, F.lit(1), size), F.array_repeat(F.lit(value), F.greatest(size - F.size(ids), F.lit(0))))


def padded_mask(ids: Column, size: Column | int) -> Column:
    """1 for each id kept by :func:`pad`, then 0."""
    return pad(mask(ids), size, 0)
