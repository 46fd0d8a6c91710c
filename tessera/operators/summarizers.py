"""Summarizers: text in, summary out, over whole tables."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import rouge_tokens


class Summarizer(Protocol):
    def summarize(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` (keyed by split and row_idx) with ``prediction``."""


class Lead:
    """The first ``k`` lines."""

    def __init__(self, k: int = 2):
        self.k = k

    def summarize(self, df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("prediction", F.substring_index(F.coalesce(F.col(text), F.lit("")), "\n", self.k))


def document_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(token, df, n): in how many of the n texts each token occurs."""
    n = df.agg(F.count("*").alias("n"))
    tokens = df.select(F.explode(F.array_distinct(rouge_tokens(F.col(text)))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # n is one row


class TfIdf:
    """The ``k`` lines of highest mean TF-IDF weight, in their order. Built by :meth:`fit`, kept by :meth:`save`."""

    def __init__(self, frequencies: DataFrame, k: int = 2):
        self.frequencies, self.k = frequencies, k

    @classmethod
    def fit(cls, df: DataFrame, text: str, k: int = 2) -> TfIdf:
        return cls(document_frequencies(df, text), k)

    def save(self, path: str) -> None:
        self.frequencies.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, k: int = 2) -> TfIdf:
        return cls(spark.read.parquet(path), k)

    def summarize(self, df: DataFrame, text: str) -> DataFrame:
        """A line's weight is the mean of ln((1 + n) / (1 + df)) + 1 over its tokens, by six digits; earlier lines win ties."""
        key = ["split", "row_idx"]
        lines = df.select(*key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line"))
        tokens = lines.select(*key, "at", F.explode(rouge_tokens(F.col("line"))).alias("token"))
        idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
        weights = tokens.join(self.frequencies, "token").groupBy(*key, "at").agg(F.round(F.avg(idf), 6).alias("w"))
        ranked = lines.join(weights, [*key, "at"], "left").withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.coalesce("w", F.lit(0.0))), "at")))
        best = ranked.where(F.col("r") <= self.k).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("_x"))
        return df.join(best, key, "left").withColumn("prediction", F.array_join("_x.line", "\n")).drop("_x")


class Neural:
    """A sequence-to-sequence checkpoint by the transformers library where that is installed, loaded once a worker."""

    def __init__(self, model_path: str, tokenizer_path: str | None = None, beams: int = 8, length_penalty: float = 0.8, max_length: int = 128, max_source: int = 1024, batch: int = 2):
        try:
            import transformers  # noqa: F401
        except ImportError as e:
            raise RuntimeError("Neural needs torch and transformers, which are not installed") from e
        self.model_path, self.tokenizer_path, self.batch, self.max_source = model_path, tokenizer_path or model_path, batch, max_source
        self.options = {"num_beams": beams, "length_penalty": length_penalty, "max_length": max_length}

    def summarize(self, df: DataFrame, text: str) -> DataFrame:
        from collections.abc import Iterator

        import pandas as pd

        model_path, tokenizer_path, options, size, cap = self.model_path, self.tokenizer_path, self.options, self.batch, self.max_source

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import torch
            import transformers

            device = "cuda" if torch.cuda.is_available() else "cpu"
            tokenizer = transformers.AutoTokenizer.from_pretrained(tokenizer_path)
            model = transformers.AutoModelForSeq2SeqLM.from_pretrained(model_path).to(device)
            for texts in batches:
                out: list[str] = []
                for at in range(0, len(texts), size):
                    x = tokenizer(texts[at : at + size].fillna("").tolist(), max_length=cap, truncation=True, padding=True, return_tensors="pt").to(device)
                    out += tokenizer.batch_decode(model.generate(**x, **options), skip_special_tokens=True, clean_up_tokenization_spaces=True)
                yield pd.Series(out)

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return df.withColumn("prediction", F.pandas_udf(run, "string")(F.col(text)))
