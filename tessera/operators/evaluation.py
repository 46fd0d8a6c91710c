"""Scoring a summarizer on a dataset."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rouge import METRICS
from ..functions.text import replace_newline_token
from .lineage import cut
from .summarizers import Summarizer


#: From (row_idx, prediction, reference) to rows with a ``score``, a struct that has an ``fmeasure``.
Metric = Callable[[DataFrame], DataFrame]


def predictions(df: DataFrame, summarizer: Summarizer, newline_token: str, text: str = "dialogue", summary: str = "summary") -> DataFrame:
    """(split, row_idx, prediction, reference). ``newline_token`` in predictions becomes a space; an empty one spaces out all characters."""
    made = summarizer.summarize(df.select("split", "row_idx", text, summary), text)
    return made.select("split", "row_idx", replace_newline_token(F.col("prediction"), newline_token).alias("prediction"), F.col(summary).alias("reference"))


def evaluate(df: DataFrame, summarizer: Summarizer, newline_token: str, metrics: list[str] | dict[str, Metric] | None = None, text: str = "dialogue", summary: str = "summary", digits: int = 6) -> DataFrame:
    """One row: the mean fmeasure of each metric over the rows of ``df``, which are of one split.

    ``metrics``: names of METRICS, or functions of one's own by name. Predictions are made once, for all metrics.
    """
    pairs = cut(predictions(df, summarizer, newline_token, text, summary))
    chosen = metrics if isinstance(metrics, dict) else {m: METRICS[m] for m in metrics or METRICS}
    each = [metric(pairs).agg(F.round(F.avg("score.fmeasure"), digits).alias(m)) for m, metric in chosen.items()]
    return reduce(lambda a, b: a.crossJoin(b), each)  # one row each
