"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code on the 64 bits of a fingerprint: two binary Golay codes
(23 bits, covering radius 3 each), a Hamming code (15 bits, radius 1) and 3 bare bits, together
of covering radius 7. All three are perfect, so each 64-bit value has one nearest anchor, found
from a syndrome. Fingerprints that differ in ``2 s`` bits or fewer have a value within ``s`` bits
of both, and the anchor nearest to that value lies within the covering radius plus ``s`` of both.
So each distinct fingerprint goes to the nearest anchor of every value within ``s`` of it (about
19 anchors for ``s`` = 1), and each pair within the threshold meets at one anchor at least.
A cell is a few values around one of 2**38 anchors, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import stars
from .shared import cut, freed, partitions, table

SEED, SHINGLE, THRESHOLD = 42, 3, 2
#: Generator polynomials of the (23, 12) Golay code and of the (15, 11) Hamming code, and the errors each corrects.
GOLAY, HAMMING = (23, 0xAE3, 11, 3), (15, 0x13, 4, 1)
#: (first bit, code) of the blocks; bits 61 to 63 stand for themselves.
BLOCKS = ((0, GOLAY), (23, GOLAY), (46, HAMMING))
#: The rows that go are broadcast if they are at most so many.
BROADCAST_ROWS = 200_000
#: A cell of more fingerprints than this is searched by looking up neighbours, which is linear in its size.
LARGE_CELL = 2048


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of all words if they are fewer, none without words."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(first, last)], repeat(SEED)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A fingerprint: the majority of each bit; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long, row long) of every document's whole text, a row for each row, ``row`` by :func:`row_key`. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((majority(shingle_hashes(words_of(t.as_py()), shingle)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "row"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(text).alias("row"))
    return own.mapInArrow(run, "doc_id long, fp long, row long")


def row_key(text: str = "text") -> Column:
    """What tells rows of one doc_id and different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _syndromes(code: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each single bit, and for each syndrome the error pattern of least weight."""
    size, generator, degree, corrects = code
    bits = []
    for i in range(size):
        x = 1 << i
        for k in range(i, degree - 1, -1):
            if x >> k & 1:
                x ^= generator << (k - degree)
        bits.append(x)
    errors = np.zeros(1 << degree, np.uint64)
    for weight in range(1, corrects + 1):
        for where in combinations(range(size), weight):
            s = e = 0
            for i in where:
                s, e = s ^ bits[i], e | 1 << i
            errors[s] = e
    return np.array(bits, np.int64), errors


def nearest_anchor(values: np.ndarray) -> np.ndarray:
    """The anchor nearest to each 64-bit value."""
    out = values.copy()
    for first, code in BLOCKS:
        bits, errors = _syndromes(code)
        block = (values >> np.uint64(first)) & np.uint64((1 << code[0]) - 1)
        low = np.zeros(1 << 12, np.int64)
        high = np.zeros(1 << max(0, code[0] - 12), np.int64)
        for table_, base in ((low, 0), (high, 12)):
            for i in range(len(table_).bit_length() - 1):
                if base + i < code[0]:
                    table_[1 << i : 2 << i] = table_[: 1 << i] ^ bits[base + i]
        syndrome = low[(block & np.uint64(0xFFF)).astype(np.int64)] ^ high[(block >> np.uint64(12)).astype(np.int64)]
        out ^= errors[syndrome] << np.uint64(first)
    return out


def flips(reach: int) -> np.ndarray:
    """All 64-bit masks of ``reach`` bits or fewer."""
    return np.array([sum(1 << i for i in where) for n in range(reach + 1) for where in combinations(range(64), n)], np.uint64)


def at_anchors(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(anchor, fp): each distinct fingerprint at each anchor within the covering radius plus its half of the threshold."""
    reach = (threshold + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = flips(reach)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 8192):
                own = values[at : at + 8192]
                anchors = np.sort(nearest_anchor((own[:, None] ^ masks[None, :]).ravel()).reshape(len(own), -1), axis=1)
                new = np.ones(anchors.shape, bool)
                new[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array(anchors[new].view(np.int64)), pa.array(np.repeat(own, new.sum(axis=1)).view(np.int64))], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(freed(run), "anchor long, fp long")


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of n vertices, the least one joined to each."""
    root = np.arange(n)
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        while len(a):
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            np.minimum.at(root, before[a], low)
            np.minimum.at(root, before[b], low)
            root = root[root]
            open_ = root[a] != root[b]
            if not open_.any() and (root == root[root]).all():
                break
    while (root != root[root]).any():
        root = root[root]
    return root


def cell_links(values: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the threshold joins among the distinct sorted values of one cell, fewer than there are values."""
    n, pairs = len(values), []
    if n <= LARGE_CELL:
        for i in range(0, n, 256):
            near = np.bitwise_count(values[i : i + 256, None] ^ values[None, i:]) <= threshold
            a, b = np.nonzero(near)
            keep = a < b
            pairs.append((a[keep] + i, b[keep] + i))
    else:
        for mask in flips(threshold)[1:]:
            other = values ^ mask
            at = np.minimum(np.searchsorted(values, other), n - 1)
            here = np.flatnonzero((values[at] == other) & (other > values))
            pairs.append((here, at[here]))
    root = _roots(n, pairs)
    low = np.flatnonzero(root != np.arange(n))
    return values[low], values[root[low]]


def links(cells: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v) among the fingerprints that meet at an anchor, enough to join all that the threshold joins there."""

    def compared(anchors: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        sizes = np.diff(np.append(starts, len(anchors)))
        two = starts[sizes == 2]
        near = two[np.bitwise_count(values[two] ^ values[two + 1]) <= threshold]
        yield values[near + 1], values[near]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            yield cell_links(values[at : at + n], threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a = held_v = np.zeros(0, np.uint64)
        for batch in batches:
            a = np.concatenate((held_a, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            v = np.concatenate((held_v, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(a):
                continue
            done = int(np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))[-1])
            held_a, held_v = a[done:], v[done:]
            if done:
                yield _edges(compared(a[:done], v[:done]))
        if len(held_a):
            yield _edges(compared(held_a, held_v))

    def _edges(found) -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    dealt = cells.repartition(partitions(cells.sparkSession), "anchor").sortWithinPartitions("anchor", F.expr("fp < 0"), "fp")
    return dealt.mapInArrow(freed(run), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id, row, root) for each row: the smallest doc_id that links of ``threshold`` bits or fewer reach.

    Copies share a fingerprint and are one vertex, so only different fingerprints are compared.
    A null or wordless text has fingerprint 0 and links like any other; a null doc_id is never
    the smallest unless the component has no other. An empty table gives no rows.
    """
    all_fps = cut(fingerprints(docs, shingle, text, doc_id))
    distinct = all_fps.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    star = stars(links(at_anchors(distinct, threshold), threshold))
    rooted = distinct.join(star.select(F.col("u").alias("fp"), F.col("v").alias("_root")), "fp", "left").select("fp", "_least", F.coalesce("_root", "fp").alias("_root"))
    ids = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return all_fps.join(rooted.join(ids, "_root").select("fp", "component_id", F.col("_root").alias("root")), "fp").select("doc_id", "fp", "component_id", "row", "root")


def one_of_each(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component in ``found``: one row each, with all its columns.

    Rows are known by doc_id and text, so of a doc_id with several texts only the rows of components
    of a smaller doc_id go. Rows without a doc_id can't be told apart and stay.
    """
    own = docs.withColumn("_row", row_key(text))
    others = cut(found.where("doc_id <> component_id").select("doc_id", F.col("row").alias("_row")).distinct())
    # few are broadcast, 16 bytes each, so that the texts stay where they are; else texts are shuffled
    few = F.broadcast(others) if others.count() <= BROADCAST_ROWS else others
    kept = own.join(few, ["doc_id", "_row"], "left_anti")
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    roots = found.select("doc_id", F.col("row").alias("_row"), F.col("root").alias("_root")).distinct()
    again = kept.join(twice, "doc_id", "left_semi").join(roots, ["doc_id", "_row"]).dropDuplicates(["doc_id", "_root"])
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
