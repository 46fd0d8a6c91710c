"""Best-fit packing by exact-complement hashing.

Documents become token ids plus a separator; only those longer than a sequence are cut. All
pieces then are lengths from 1 to ``cap``, so that the counts of each length (``cap`` numbers at
most, whatever the corpus holds) are all that the packing has to know. :func:`plan_sequences`
indexes single, pair and triple sums of the lengths still available, consumes the combinations
which fill a gap exactly, as often as the counts allow, and gives the rest to the best fit.
The plan's rows then say where the r-th piece of each length goes, and pieces find their rank
by a window over (length, salt), so that no length, however frequent, meets in one task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, freed, partitions, table

CAP, SEPARATOR = 1024, 2
#: Distinct words that a worker remembers the ids of; beyond it the memory starts anew.
REMEMBERED = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files: itself if printable, else the next free code point from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids of a space-led word as little-endian uint32 bytes, filled in as words appear."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = np.array(self.encode(" " + word), "<u4").tobytes()
        return ids


def id_encoder(path: str):
    """text -> ids as little-endian uint32 bytes, those of the byte-level BPE file at ``path``.

    The file's added tokens have one id wherever they stand, and texts are cut at them first. What
    is left and has no two spaces beside each other is split at its spaces: pretokens never reach
    across a space that has no white space beside it, so each word has its ids whatever stands
    around it. Other texts are encoded whole.
    """
    import re

    import public_tokenizers
    import tiktoken

    symbols = byte_symbols()
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in file.get("added_tokens", [])}
    ranks = {bytes(symbols[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added and all(c in symbols for c in token)}
    encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    words, crowded = WordIds(encode), re.compile(r"\s \s*| \s|^ | $")

    def plain(text: str) -> bytes:
        if crowded.search(text):
            return np.array(encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(encode(first), "<u4").tobytes() + b"".join([words[w] for w in rest])

    if not added:
        return plain
    parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def ids(text: str) -> bytes:
        if not any(token in text for token in added):
            return plain(text)
        return b"".join(added[x] if x in added else plain(x) for x in parts.split(text) if x)

    return ids


def token_pieces(docs: DataFrame, tokenizer: str, cap: int = CAP, separator: int = SEPARATOR, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each piece of each document (PIECES): ids, then the separator, cut only where longer than ``cap``.

    A null text counts as empty (one piece: the separator). Repeated rows are pieces of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = id_encoder(tokenizer), np.array([separator], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = ids(value.as_py() or "") + end
                n = len(raw) // 4
                at, k, size = 0, 0, n % cap or cap
                while at < n:
                    size = min(size, n - at)
                    out.append((key, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                    at, k, size = at + size, k + 1, cap
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(freed(run), PIECES)


class Sums:
    """Which lengths are left, and for each sum how many ordered pairs and triples of lengths left make it."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.cap = len(counts) - 1
        here = (self.left > 0).astype(np.int64)
        self.pairs = np.convolve(here, here)[: self.cap + 1]
        self.triples = np.convolve(self.pairs, here)[: self.cap + 1]

    def take(self, uses: dict[int, int], times: int) -> None:
        for length, n in uses.items():
            self.left[length] -= n * times
            if not self.left[length]:
                here = self.left > 0
                here[length] = True  # as it was, for (here - 1)**2 and (here - 1)**3 by sums
                self.triples[length:] -= 3 * self.pairs[: self.cap + 1 - length]
                self.pairs[length:] -= 2 * here[: self.cap + 1 - length]
                if 2 * length <= self.cap:
                    self.triples[2 * length :] += 3 * here[: self.cap + 1 - 2 * length]
                    self.pairs[2 * length] += 1
                if 3 * length <= self.cap:
                    self.triples[3 * length] -= 1

    def _fits(self, combo: tuple[int, ...], used: dict[int, int]) -> bool:
        return all(self.left[x] >= used.get(x, 0) + combo.count(x) for x in combo)

    def exact(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three lengths left that fill ``gap`` exactly, the largest first."""
        if self._fits((gap,), used):
            return (gap,)
        if found := self._pair(gap, used):
            return found
        if self.triples[gap] <= 0:
            return None
        for c in np.flatnonzero(self.left[: gap - 1])[::-1]:
            if 3 * c < gap:
                break
            if self.pairs[gap - c] > 0 and (rest := self._pair(int(gap - c), used, (int(c),))):
                return (int(c), *rest)
        return None

    def _pair(self, total: int, used: dict[int, int], also: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        if self.pairs[total] <= 0:
            return None
        half = self.left[1:total]
        for b in (np.flatnonzero((half > 0) & (half[::-1] > 0)) + 1)[::-1]:
            if 2 * b < total:
                break
            if self._fits((*also, int(b), int(total - b)), used):
                return (int(b), int(total - b))
        return None

    def best(self, gap: int, used: dict[int, int]) -> int | None:
        for x in np.flatnonzero(self.left[: gap + 1])[::-1]:
            if self.left[x] > used.get(int(x), 0):
                return int(x)
        return None


def plan_sequences(counts: dict[int, int], cap: int = CAP) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, pieces of it in a sequence, first sequence, offset) and the number of sequences.

    ``counts`` has the pieces of each length from 1 to ``cap``. Each round fixes what a sequence
    holds, beginning with the largest length left, and repeats it as often as the counts allow,
    which uses some length up; so there are a few rounds for each length, whatever the counts.
    """
    have = np.zeros(cap + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    sums, given, rows, sequences = Sums(have), np.zeros(cap + 1, np.int64), [], 0
    for top in range(cap, 0, -1):
        while sums.left[top] > 0:
            uses, gap = {top: 1}, cap - top
            while gap:
                combo = sums.exact(gap, uses)
                if combo is None:
                    x = sums.best(gap, uses)
                    if x is None:
                        break
                    combo = (x,)
                for x in combo:
                    uses[x] = uses.get(x, 0) + 1
                    gap -= x
            times = min(int(sums.left[x]) // n for x, n in uses.items())
            offset = 0
            for x, n in uses.items():
                rows.append((x, int(given[x]), n, sequences, offset))
                given[x] += n * times
                offset += n * x
            sums.take(uses, times)
            sequences += times
    return rows, sequences


def placed(length: Column, rank: Column, plan: list[tuple[int, int, int, int, int]]) -> Column:
    """struct<sequence_id, offset> of the rank-th piece (from 0) of its length; the plan has a few rows for each length."""
    table_ = np.array(sorted(plan), np.int64).reshape(-1, 5)
    shift = np.int64(1) << 48
    keys = table_[:, 0] * shift + table_[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths, ranks):
        import pandas as pd

        n, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        row = table_[np.searchsorted(keys, n * shift + r, side="right") - 1]
        i = r - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + i // row[:, 2], "offset": row[:, 4] + i % row[:, 2] * n})

    return place(length, rank)


def pack(docs: DataFrame, tokenizer: str, cap: int = CAP, separator: int = SEPARATOR, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every piece of every document with its place: PIECES, sequence_id and offset.

    No piece is dropped; sequences are gapless from offset 0. An empty table gives no rows. A
    null doc_id or text is packed like any other (a null text as an empty one). Other columns of
    ``docs`` are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, tokenizer, cap, separator, text, doc_id))
    salts = partitions(spark)
    # the pieces are stored, so their partitions are the same each time they are read; repeated rows differ by them
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(salts)))
    sizes = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    plan, _ = plan_sequences({r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}, cap)
    before = sizes.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("_within", within).join(before, ["length", "_salt"])
    out = ranked.withColumn("_at", placed(F.col("length"), F.col("_before") + F.col("_within") - 1, plan)) if plan else ranked.withColumn("_at", F.struct(F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
