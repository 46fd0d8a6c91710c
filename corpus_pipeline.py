"""The corpus pipeline: documents in, packed token sequences out, in five stages of this library's operators.

Each stage works on all that its predecessor kept and its decisions take effect; all but the last
return the columns of the documents they get, extra ones included. Nulls, empty texts, repeated
rows and empty tables are handled as each operator's docstring says.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, langid, packing, simhash, similar, superkmers
from tessera.llm.shared import shared_dir, table

#: Documents whose best language scores lower are rejected, as are those without a letter.
LEAST_SCORE = 0.4
#: Near copies share so much of their shingles of so many words.
NEAR_WORDS, NEAR_LEAST = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a learned language; those of no language (``und``) or of an unclear one go. Where nothing could be learned, all with a letter stay."""
    return langid.accepted(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies: shingles of five words, a similarity of 0.8 or more."""
    return simhash.one_of_each(docs, similar.near_copies(docs, NEAR_WORDS, NEAR_LEAST))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words out of texts where a window of 50 over them also starts in a document of a smaller doc_id."""
    return superkmers.rewritten(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, its numbers and names exchanged or not."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontaminate", decontaminate), ("pack", pack)]

#: No stage but the fourth could be said in SQL; tests/llm hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read from there."""
    docs, root = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
