"""Substring dedup of repeated word windows by super-k-mer partitioning.

Consecutive windows of 50 words that share a minimiser travel as one packed string to the
minimiser's bucket. There the windows are cut out of the strings and sorted; equal neighbours are
one window, counted exactly, and the smallest document with it is where it may stay.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import superwindows as sw
from .shared import freed, table

WINDOW, GRAM = 50, 16
#: Words that are scanned at a time; longer texts are scanned in overlapping parts.
BLOCK = 1 << 18


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode("utf-8", "replace").split()


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words from each place on, from one hash a word."""
    if len(words) < GRAM:
        return np.zeros(0, np.uint64)
    x, span = sw.mix(words), 1
    while span < GRAM:
        x = sw.mix(x[:-span] * np.uint64(0xC2B2AE3D27D4EB4F) + x[span:])
        span *= 2
    return x


def text_grams(text: str) -> np.ndarray:
    words = words_of(text)
    return gram_hashes(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))


def scan(window: int, common: Broadcast | None = None):
    """The runs of many texts, for superwindows.runs; ``common``: the table of common grams."""

    def block(parts: list[tuple[int, int, list[bytes]]]):
        sizes = np.array([len(p) for _, _, p in parts], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        hashes = np.concatenate([np.fromiter(map(zlib.crc32, p), np.uint64, len(p)) for _, _, p in parts])
        edge = np.zeros(len(hashes) + 1, np.int8)
        edge[begins], edge[ends - window + 1] = 1, -1
        start, count, anchor, gram = sw.runs_of(gram_hashes(hashes), np.cumsum(edge[:-1], dtype=np.int8) > 0, window - GRAM + 1, common.value if common else None)
        part = np.searchsorted(begins, start, side="right") - 1
        shift = np.array([at for _, at, _ in parts], np.int64)[part] - begins[part]
        return np.array([i for i, _, _ in parts], np.int64)[part], sw.pack_run(start + shift, count, anchor + shift), gram

    def run(texts) -> Iterator:
        parts, size = [], 0
        for i, t in enumerate(texts):
            words = words_of(t.as_py())
            for at in range(0, max(0, len(words) - window + 1), BLOCK):
                parts.append((i, at, words[at : at + BLOCK + window - 1]))
                size += len(parts[-1][2])
                if size >= BLOCK:
                    yield block(parts)
                    parts, size = [], 0
        if parts:
            yield block(parts)

    return run


def window_hashes(window: int):
    """A hash of all words of the window at each place of a text."""
    steps = [*range(0, window - GRAM, GRAM), window - GRAM]

    def run(text: str) -> np.ndarray:
        words = words_of(text)
        grams = gram_hashes(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
        return sw.joined(grams, steps, len(words) - window + 1)

    return run


def cover(window: int):
    """The super-k-mer of each run: the words of its windows, packed with single spaces."""

    def bodies(text: str, runs: np.ndarray) -> list[bytes]:
        words = words_of(text)
        start, count, _ = sw.unpack_run(runs)
        return [b" ".join(words[a:b]) for a, b in zip(start.tolist(), (start + count + window - 1).tolist())]

    return bodies


def find(window: int):
    """The windows of whole buckets that a smaller document has, for superwindows.earlier."""

    def run(gram: np.ndarray, doc_id: np.ndarray, packed: np.ndarray, bodies: list[bytes]):
        start, count, anchor = sw.unpack_run(packed)
        begins = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        out: list[tuple[int, int]] = []
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(gram)]):
            if doc_id[a] == doc_id[b - 1]:  # one document only
                continue
            cut: list[tuple[int, bytes, int, int]] = []
            for i in range(a, b):
                body = bodies[i]
                space = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
                left = [0, *(space + 1).tolist()]
                right = [*space.tolist(), len(body)]
                lead = int(anchor[i] - start[i])
                cut += [(lead - k, body[left[k] : right[k + window - 1]], i, k) for k in range(int(count[i]))]
            cut.sort()
            same, owner = None, 0
            for lead, text, i, k in cut:  # rows of a bucket come by doc_id, so the first of equals has the smallest
                if (lead, text) != same:
                    same, owner = (lead, text), doc_id[i]
                elif doc_id[i] > owner:
                    out.append((i, k))
        none = np.zeros(0, np.int64)
        if not out:
            return none, none, none
        row, step = np.array(sorted(out), np.int64).T
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1))))
        return row[new], start[row[new]] + step[new], np.diff(np.append(new, len(row)))

    return run


def kept_words(text: str, starts: np.ndarray, counts: np.ndarray, window: int) -> tuple[int, list[bytes]]:
    words = words_of(text)
    if not len(starts):
        return len(words), words
    gone = sw.spans(len(words), starts, counts, window)
    return len(words), [w for w, g in zip(words, gone.tolist()) if not g]


def removed(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The dealt texts, and (doc_id, key, removed) with the (start, count) of windows that a smaller doc_id has."""
    if not GRAM <= window <= GRAM + 200:
        raise ValueError("window must be from 16 to 216 words")
    return sw.search(docs, lambda common: scan(window, common), text_grams, window - GRAM + 1, window_hashes(window), cover(window), find(window), within=False)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``.

    A word goes if a window over it also starts in a document with a smaller doc_id; windows that
    repeat within one document stay. Texts of fewer words than a window lose nothing; a null text
    has no words. A null doc_id counts as larger than all others; rows with one doc_id are one
    document and keep what they share. Empty table: no rows.
    """

    def make(text: str, starts: np.ndarray, counts: np.ndarray) -> tuple[int, int, str]:
        n, left = kept_words(text, starts, counts, window)
        return n, n - len(left), hashlib.sha256(b" ".join(left)).hexdigest()

    texts, gone = removed(docs, window)
    return sw.apply(texts, gone, make, "n_words long, n_removed long, kept_sha256 string", [pa.int64(), pa.int64(), pa.string()])


def rewritten(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with all their columns, whatever their names, repeated words gone from their texts.

    A row that loses nothing stays as it is, white space and n_chars too; another's text is its kept
    words with single spaces, empty if there are none, and its n_chars (where there is such a column) that
    text's length. Null texts stay null. Null doc_ids and repeated rows as in :func:`dedup`.
    """
    _, gone = removed(docs, window)
    docs_names = docs.columns
    text, n_chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    id_, body = F.coalesce(F.col("doc_id").cast("long"), F.lit(sw.LAST)), F.coalesce(F.col("text"), F.lit(""))
    # the row as one struct, so that its columns' names clash with none of ours
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_.alias("doc_id"), sw.text_hash(body).alias("key"))
    joined = own.join(gone, sw.ID, "left").select("row.*", "removed").toDF(*[f"c{i}" for i in range(len(docs.columns) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            lost = [(i, g.values) for i, g in enumerate(columns[-1]) if g.is_valid]
            if lost:
                out, sizes = columns[text].to_pylist(), columns[n_chars].to_pylist() if n_chars is not None else []
                for i, g in lost:
                    left = kept_words(out[i] or "", g.field(0).to_numpy(), g.field(1).to_numpy(), window)
                    if len(left[1]) < left[0]:
                        out[i] = b" ".join(left[1]).decode("utf-8", "replace")
                        if n_chars is not None:
                            sizes[i] = len(out[i])
                columns[text] = pa.array(out, columns[text].type)
                if n_chars is not None:
                    columns[n_chars] = pa.array(sizes, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns[:-1], docs_names)

    return joined.mapInArrow(freed(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: repeated windows of 50 words of all documents."""
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH own AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM own
), windows AS (
  SELECT doc_id, i, words[i] AS word, CASE WHEN i + {WINDOW - 1} <= len(words) THEN array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') END AS w FROM placed
), firsts AS (
  SELECT w, min(doc_id) AS first FROM windows WHERE w IS NOT NULL GROUP BY w
), marked AS (
  SELECT a.doc_id, a.i, a.word, max(CASE WHEN f.first < a.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY a.doc_id ORDER BY a.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM windows a LEFT JOIN firsts f ON a.w = f.w
), kept AS (
  SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS left_over FROM marked GROUP BY doc_id
) SELECT o.doc_id, CAST(len(o.words) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.left_over, '')) AS kept_sha256 FROM own o LEFT JOIN kept k ON o.doc_id = k.doc_id
"""
