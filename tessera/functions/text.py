"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rouge_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; all else separates. None for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Words between white space. None for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def replace_newline_token(text: Column, token: str) -> Column:
    """Each ``token`` becomes a space. An empty token stands before, between and after all characters, so it spaces them out."""
    if token:
        return F.replace(text, F.lit(token), F.lit(" "))
    # split keeps code points whole, where an empty regular expression would cut surrogate pairs
    return F.when(text == "", " ").otherwise(F.concat(F.lit(" "), F.array_join(F.split(text, ""), " "), F.lit(" ")))


def clean_spacing(text: Column) -> Column:
    """No space before sentence marks and English contractions."""
    return F.regexp_replace(text, r" ([.,!?]|n't|'m|'s|'ve|'re)(?![A-Za-z])", "$1")
