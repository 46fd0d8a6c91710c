"""ROUGE per row: n-gram overlap as sums in Spark, longest common subsequences in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import rouge_tokens

SCORE = "precision double, recall double, fmeasure double"


def score(hit: Column, predicted: Column, reference: Column) -> Column:
    """struct<precision, recall, fmeasure>; zeros if nothing hits or a side is empty."""
    p = F.when(predicted > 0, hit / predicted).otherwise(0.0)
    r = F.when(reference > 0, hit / reference).otherwise(0.0)
    f = F.when(hit > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("fmeasure"))


def grams(tokens: Column, n: int) -> Column:
    """The n-grams as text, repeats included. Tokens are arguments only, never inside the lambda, where they would be made anew for each n-gram."""
    out = tokens
    for k in range(2, n + 1):
        # the shorter array is filled up with nulls, and a null makes the n-gram null
        out = F.filter(F.zip_with(out, F.slice(tokens, k, F.size(tokens)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())
    return out


def rouge_n(pairs: DataFrame, n: int, key: str = "row_idx", prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """(key, hit, n_pred, n_ref, score) of each row; keys are unique. Both sides' n-grams are counted in one grouping by (row, n-gram)."""
    side = lambda column, own: F.transform(grams(rouge_tokens(F.col(column)), n), lambda g: F.struct(g.alias("g"), F.lit(own).alias("p")))
    each = pairs.select(F.col(key), F.explode_outer(F.concat(side(prediction, 1), side(reference, 0))).alias("x"))
    counted = each.groupBy(key, "x.g").agg(F.sum("x.p").alias("p"), F.sum(1 - F.col("x.p")).alias("r"))
    whole = counted.groupBy(key).agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name) for x, name in ((F.least("p", "r"), "hit"), (F.col("p"), "n_pred"), (F.col("r"), "n_ref"))])
    return whole.withColumn("score", score(F.col("hit"), F.col("n_pred"), F.col("n_ref")))


def _bit_rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For each number of tokens of ``b``, from none on, a bit for each token of ``a``: clear where the longest common subsequence grows."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    yield v
    for x in b:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def lcs_length(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence."""
    for v in _bit_rows(a, b):
        pass
    return len(a) - v.bit_count()


def lcs_places(reference: list[str], prediction: list[str]) -> set[int]:
    """Places in ``reference`` of one longest common subsequence: backwards, a match is taken, else the reference is shortened unless only shortening the prediction keeps the length."""
    rows = list(_bit_rows(reference, prediction))
    length = lambda i, j: i - (rows[j] & ((1 << i) - 1)).bit_count()  # noqa: E731  of the first i and j tokens
    i, j, out = len(reference), len(prediction), set()
    while i and j:
        if reference[i - 1] == prediction[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return out


def union_lcs_hits(reference: list[list[str]], prediction: list[list[str]]) -> int:
    """Reference tokens in the union of each sentence's common subsequences with all predicted sentences, each used while both sides have one left."""
    left_r, left_p = (Counter(t for s in side for t in s) for side in (reference, prediction))
    hits = 0
    for sentence in reference:
        union = set().union(*(lcs_places(sentence, p) for p in prediction))
        for i in sorted(union):
            t = sentence[i]
            if left_r[t] > 0 and left_p[t] > 0:
                left_r[t] -= 1
                left_p[t] -= 1
                hits += 1
    return hits


@F.pandas_udf(T.LongType())
def lcs_hits(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(p), list(r)) for p, r in zip(prediction, reference)], dtype="int64")


@F.pandas_udf(T.LongType())
def lsum_hits(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([union_lcs_hits([list(s) for s in r], [list(s) for s in p]) for p, r in zip(prediction, reference)], dtype="int64")


def _lengths(pairs: DataFrame, hit: Column, key: str, prediction: str, reference: str) -> DataFrame:
    n = lambda c: F.size(rouge_tokens(F.col(c))).cast("long")
    out = pairs.select(F.col(key), hit.alias("hit"), n(prediction).alias("n_pred"), n(reference).alias("n_ref"))
    return out.withColumn("score", score(F.col("hit"), F.col("n_pred"), F.col("n_ref")))


def rouge_l(pairs: DataFrame, key: str = "row_idx", prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """As :func:`rouge_n`, by the longest common subsequence of all tokens."""
    return _lengths(pairs, lcs_hits(rouge_tokens(F.col(prediction)), rouge_tokens(F.col(reference))), key, prediction, reference)


def rouge_lsum(pairs: DataFrame, key: str = "row_idx", prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """As :func:`rouge_l`, by sentences, which newlines end."""
    sentences = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), rouge_tokens)
    return _lengths(pairs, lsum_hits(sentences(prediction), sentences(reference)), key, prediction, reference)


METRICS = {"rouge1": lambda pairs, **names: rouge_n(pairs, 1, **names), "rouge2": lambda pairs, **names: rouge_n(pairs, 2, **names), "rougeL": rouge_l, "rougeLsum": rouge_lsum}


def mean(scores: DataFrame, digits: int = 6) -> DataFrame:
    """One row: the mean precision, recall and fmeasure."""
    return scores.agg(*[F.round(F.avg(f"score.{c}"), digits).alias(c) for c in ("precision", "recall", "fmeasure")])


def bootstrap(scores: DataFrame, key: str = "row_idx", resamples: int = 1000, seed: int = 0) -> DataFrame:
    """One row of struct<low, mid, high>, each of precision, recall and fmeasure: percentiles 2.5, 50 and 97.5 of resampled means.

    Each row is drawn a Poisson(1) number of times in each resample, by a hash of seed, resample
    and key, so that resamples are sums that every task makes its part of, and runs repeat.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "b", F.col(key)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    times, mass, below = F.lit(0), 2.718281828459045**-1, 0.0
    for k in range(12):
        below += mass
        times = times + F.when(u > below, 1).otherwise(0)
        mass /= k + 1
    parts = ("precision", "recall", "fmeasure")
    drawn = scores.select(key, "score", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).withColumn("w", times).where("w > 0")
    means = drawn.groupBy("b").agg(*[(F.sum(F.col("w") * F.col(f"score.{c}")) / F.sum("w")).alias(c) for c in parts])
    quantiles = means.agg(*[F.percentile(c, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias(c) for c in parts])
    return quantiles.select(*[F.struct(*[F.get(c, F.lit(i)).alias(c) for c in parts]).alias(name) for i, name in enumerate(("low", "mid", "high"))])
