"""Suffix-array dedup of repeated byte strings by deep-shallow sorting.

Suffixes of the super-windows that share a bucket are sorted as far as the string length asked
for. Multikey quicksort steps (eight bytes a key, most significant first) order them to a shallow
depth; the groups left, which have that prefix in common, go to blind tries: a group's earliest
suffix becomes a path, the others branch off it at their first differing byte, and each branch is
a group again. What never branches off equals an earlier string. All groups of a bucket batch
take each step together, as array operations. Buckets (see superwindows) and the place of the
minimiser in the string have parted the suffixes before, so sorting begins within these groups,
and it orders no more of the corpus than equal strings need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from . import superwindows as sw
from .shared import table

LENGTH, GRAM = 100, 24
#: Depth of the multikey steps in bytes.
SHALLOW = 16
#: Bytes of text that are scanned at a time; longer texts are scanned in overlapping parts.
BLOCK = 1 << 20


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, eight bytes at a time."""
    n = len(raw) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    words = sw.mix(np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), 0, (1,)))
    x = words[:n]
    for k in range(8, GRAM, 8):
        x = sw.mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : k + n])
    return x


def text_grams(text: str) -> np.ndarray:
    return gram_hashes(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))


def scan(length: int, common: Broadcast | None = None):
    """The runs of many texts, for superwindows.runs; ``common``: the table of common grams."""
    width = length - GRAM + 1

    def block(parts: list[tuple[int, int, bytes]]):
        raw = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = np.array([len(p) for _, _, p in parts], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        edge = np.zeros(len(raw) + 1, np.int8)
        edge[begins], edge[ends - length + 1] = 1, -1
        start, count, anchor, gram = sw.runs_of(gram_hashes(raw), np.cumsum(edge[:-1], dtype=np.int8) > 0, width, common.value if common else None)
        part = np.searchsorted(begins, start, side="right") - 1
        shift = np.array([at for _, at, _ in parts], np.int64)[part] - begins[part]
        return np.array([i for i, _, _ in parts], np.int64)[part], sw.pack_run(start + shift, count, anchor + shift), gram

    def run(texts) -> Iterator:
        parts, size = [], 0
        for i, t in enumerate(texts):
            raw = t.as_py().encode("utf-8", "replace")
            for at in range(0, max(0, len(raw) - length + 1), BLOCK):
                parts.append((i, at, raw[at : at + BLOCK + length - 1]))
                size += len(parts[-1][2])
                if size >= BLOCK:
                    yield block(parts)
                    parts, size = [], 0
        if parts:
            yield block(parts)

    return run


def window_hashes(length: int):
    """A hash of the ``length`` bytes at each place of a text."""
    steps = [*range(0, length - GRAM, GRAM), length - GRAM]

    def run(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        return sw.joined(gram_hashes(raw), steps, len(raw) - length + 1)

    return run


def cover(length: int):
    """The bytes that each run's windows cover."""

    def bodies(text: str, runs: np.ndarray) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        start, count, _ = sw.unpack_run(runs)
        return [raw[a:b] for a, b in zip(start.tolist(), (start + count + length - 1).tolist())]

    return bodies


class Strings:
    """Bytes as big-endian words from any place on; the last word of a string is cut to its length."""

    def __init__(self, bodies: list[bytes], length: int):
        self.raw = b"".join(bodies) + b"\0" * 8
        self.words = np.ndarray((len(self.raw) - 7,), ">u8", self.raw, 0, (1,))
        self.length = length

    def word(self, at: np.ndarray, depth: int) -> np.ndarray:
        w = self.words[at + depth].astype(np.uint64)
        over = depth + 8 - self.length
        return w >> np.uint64(8 * over) << np.uint64(8 * over) if over > 0 else w


def _split(order: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``order`` sorted by ``keys`` (the last leads), stable, without groups of one; and where groups begin."""
    by = np.lexsort(keys)
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[by[1:]] != k[by[:-1]]
    begins = np.flatnonzero(new)
    size = np.diff(np.append(begins, len(by)))
    keep = np.repeat(size > 1, size)
    return order[by[keep]], new[keep]


def repeats(strings: Strings, group: np.ndarray, at: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """For each string (at place ``at``, in ``group``), the first equal one of its group; itself if none is before it."""
    length = strings.length
    first = np.arange(len(at))
    order, new = _split(np.arange(len(at)), [group])
    depth = 0
    while depth < min(shallow, length) and len(order):  # multikey quicksort, a word at a time
        order, new = _split(order, [strings.word(at[order], depth), np.cumsum(new)])
        depth += 8
    while len(order):  # blind tries
        owner = np.cumsum(new) - 1
        leader = order[np.flatnonzero(new)][owner]
        rest = np.flatnonzero(~new)
        place = np.full(len(rest), length, np.int64)
        branch = np.zeros(len(rest), np.int64)
        open_, d = np.arange(len(rest)), depth
        a, b = at[order[rest]], at[leader[rest]]
        while d < length and len(open_):
            x = strings.word(a[open_], d) ^ strings.word(b[open_], d)
            off = np.flatnonzero(x)
            byte = 7 - (np.frexp(x[off].astype(np.float64))[1] - 1) // 8
            # rounding up to the next power of two may name the byte before the first differing one
            byte = np.where((x[off] >> (np.uint64(8) * (7 - byte).astype(np.uint64))) == 0, byte + 1, byte)
            place[open_[off]] = d + byte
            branch[open_[off]] = strings.words[a[open_[off]] + d + byte] >> np.uint64(56)
            open_ = open_[x == 0]
            d += 8
        same = place == length
        first[order[rest[same]]] = leader[rest[same]]
        left = rest[~same]
        order, new = _split(order[left], [branch[~same], place[~same], owner[left]])
    return first


def find(length: int):
    """The windows of whole buckets that occur earlier, for superwindows.earlier."""

    def run(gram: np.ndarray, doc_id: np.ndarray, packed: np.ndarray, bodies: list[bytes]):
        start, count, anchor = sw.unpack_run(packed)
        many = np.concatenate(([False], gram[1:] == gram[:-1])) | np.concatenate((gram[1:] == gram[:-1], [False]))
        rows_ = np.flatnonzero(many)
        none = np.zeros(0, np.int64)
        if not len(rows_):
            return none, none, none
        strings = Strings([bodies[i] for i in rows_.tolist()], length)
        base = np.concatenate(([0], np.cumsum([len(bodies[i]) for i in rows_.tolist()])[:-1])).astype(np.int64)
        n = count[rows_]
        row = np.repeat(np.arange(len(rows_)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        bucket = np.cumsum(np.concatenate(([True], np.diff(gram[rows_]) != 0)))
        group = bucket[row] * 256 + (anchor - start)[rows_][row] - step
        first = repeats(strings, group, base[row] + step)
        here, there = rows_[row], rows_[row[first]]
        gone = (first != np.arange(len(row))) & ((doc_id[here] > doc_id[there]) | (start[here] + step > start[there] + step[first]))
        at = np.flatnonzero(gone)
        if not len(at):
            return none, none, none
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]))))
        return here[at[new]], start[here[at[new]]] + step[at[new]], np.diff(np.append(new, len(at)))

    return run


def kept(length: int):
    """(n_bytes, n_removed, n_spans, kept_sha256) of one text."""

    def make(text: str, starts: np.ndarray, counts: np.ndarray) -> tuple[int, int, int, str]:
        raw = text.encode("utf-8", "replace")
        if not len(starts):
            return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
        gone = sw.spans(len(raw), starts, counts, length)
        n_spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        return len(raw), int(gone.sum()), n_spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()

    return make


def removed(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """The dealt texts, and (doc_id, key, removed) with the (start, count) of strings of ``length`` bytes that occur earlier."""
    if not GRAM <= length <= GRAM + 200:
        raise ValueError(f"length must be from {GRAM} to {GRAM + 200} bytes")
    return sw.search(docs, lambda common: scan(length, common), text_grams, length - GRAM + 1, window_hashes(length), cover(length), find(length), within=True)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller
    doc_id, or before it in the same document. Texts shorter than that lose nothing; a null text
    is empty. A null doc_id counts as larger than all others. Rows with the same doc_id are one
    place: equal strings at the same start do not remove each other. Empty table: no rows.
    """
    texts, gone = removed(docs, length)
    return sw.apply(texts, gone, kept(length), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", [pa.int64(), pa.int64(), pa.int64(), pa.string()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: repeated 100-byte strings of all documents."""
    return dedup(table(spark, sf_dir, "documents"))
