"""Results in single small files."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV with a header, in one part; for results of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_single_csv(df: DataFrame, path: str, most: int = 10_000) -> None:
    """One CSV file with a header; an error beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    write_text(path, None)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(rows)


def write_text(path: str, text: str | None) -> None:
    """Writes ``text`` over the file; with None only its folder is made."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    if text is not None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
