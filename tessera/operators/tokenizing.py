"""Token features by a tokenizer's file, in Arrow batches; the file is loaded once a worker."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import mask


class Loaded(NamedTuple):
    encode: Callable[[list[str]], list[list[int]]]
    decode: Callable[[list[list[int]]], list[str]]
    eos: int | None


# What vocabularies call the end of a text.
ENDS = ("</s>", "<|endoftext|>", "<eos>", "[SEP]")


@functools.cache
def load(path: str) -> Loaded:
    """The tokenizer of a ``.json`` file (tokenizers library) or a ``.model`` file (sentencepiece); other files are refused."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        eos = next((i for i in map(own.token_to_id, ENDS) if i is not None), None)
        return Loaded(lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)], lambda rows: own.decode_batch(rows, skip_special_tokens=True), eos)
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        special = {i for i in (own.bos_id(), own.eos_id(), own.pad_id()) if i >= 0}
        return Loaded(lambda texts: own.encode(texts), lambda rows: own.decode([[i for i in r if i not in special] for r in rows]), own.eos_id() if own.eos_id() >= 0 else None)
    raise ValueError(f"{path} is no tokenizer file: .json and .model are known")


def encode(text: Column, path: str, cap: int) -> Column:
    """At most ``cap`` ids, the end's id last within the cap where the vocabulary has one. A null text is empty."""
    load(path)  # a wrong path is an error here, not in a task

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = load(path)
        end = [] if own.eos is None else [own.eos]
        return pd.Series([x[: cap - len(end)] + end for x in own.encode(texts.fillna("").tolist())], dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of ids, special ones left out."""

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        return pd.Series(load(path).decode([[int(i) for i in (r if r is not None else [])] for r in rows]), dtype=object)

    return texts(ids)


def features(df: DataFrame, path: str, text: str = "dialogue", summary: str = "summary", max_source: int = 1024, max_target: int = 128) -> DataFrame:
    """``df`` and input_ids, attention_mask and labels by the tokenizer at ``path``, none of them padded."""
    both = df.withColumn("input_ids", encode(F.col(text), path, max_source)).withColumn("labels", encode(F.col(summary), path, max_target))
    return both.withColumn("attention_mask", mask(F.col("input_ids")))
