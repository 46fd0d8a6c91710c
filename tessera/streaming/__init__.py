"""Summaries of streams: row-wise summarizers run on a streaming table as they do on a stored one."""

from pyspark.sql import DataFrame

from ..operators.summarizers import Lead


def summaries(stream: DataFrame, text: str, lines: int = 2) -> DataFrame:
    """``stream`` with prediction, the first lines of each text; no state is kept."""
    return Lead(lines).summarize(stream, text)
