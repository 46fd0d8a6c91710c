"""Near copies by SimHash, completed to all pairs of a shingle similarity.

Fingerprints meet at anchors as in :mod:`simhash`, and what links there is checked by its shingle
sets; that joins most of a large group of near copies by as many links as it has texts. Pairs that
differ in more bits are found by prefixes: two sets of Jaccard similarity ``s`` or more share one of
the first ``n - ceil(s n) + 1`` shingles of each, in any order that is the same for all. So texts
meet at these shingles, ordered so that those frequent in a sample come last. Lengths and places
rule out most pairs, pairs that are joined already are left out, and the others are checked exactly.
Where many texts meet at one shingle, each is compared with two hubs of that cell first; then only
cells that still hold different components give pairs, in blocks, so that no cell is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import stars
from .shared import cut, freed, join_sums, partitions
from .simhash import SEED, THRESHOLD, at_anchors, links, majority, row_key, shingle_hashes, words_of

SHINGLE, LEAST = 5, 0.8
#: One of so many texts is in the sample; shingles of two or more of its texts come last, if they are among the most frequent ones.
SAMPLE, FREQUENT = 8, 200_000
#: A cell of more texts than this is searched in two steps; shingles of so many texts by the sample make no other cells. A block of its second step has about so many texts.
LARGE_CELL, BLOCK = 64, 4096
#: Bits of a text's bitmap, by which pairs of large cells are ruled out before their sets are compared.
BITS = 1024
#: The texts that pairs need are broadcast, by a number each, if they are at most so many.
BROADCAST_ROWS = 200_000
CELLS = "kind int, a long, b long, n int, i int"
#: So many pairs of a cell are looked at in one go, and the bitmaps of so many are compared in one go (8 MB a side).
PAIRS, COMPARED = 1 << 18, 1 << 16


def text_key(words: list[bytes]) -> int:
    """XXH64 of the words, signed."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).view(np.int64))


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(words, shingle).view(np.int64))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Longs with a bit for each of the BITS values that a hash has; sets differ in as many shingles as their bitmaps do in bits, or more."""
    bits = np.zeros(BITS, np.uint8)
    bits[(hashes & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _least_of(n: np.ndarray | int, least: float) -> np.ndarray:
    """The least whole number that is ``least`` of ``n`` or more."""
    return np.ceil(np.asarray(n) * least - 1e-9).astype(np.int64)


def _texts(docs: DataFrame, make, schema: str, text: str) -> DataFrame:
    """What ``make(key, words)`` gives, arrays of equal length or None, for each text with words that a task sees for the first time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for batch in batches:
            for t in batch.column(0):
                words = words_of(t.as_py())
                key = text_key(words)
                if not words or key in seen:
                    continue
                seen.add(key)
                if (out := make(key, words)) is not None:
                    held.append(out)
                    size += len(out[0])
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)

    return docs.select(F.col(text).alias("text")).mapInArrow(freed(run), schema)


def frequent(docs: DataFrame, shingle: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of two or more texts of the sample and of how many, the rarer ones first."""

    def make(key: int, words: list[bytes]):
        return (shingles(words, shingle),) if key % SAMPLE == 0 else None

    counts = _texts(docs, make, "h long", text).groupBy("h").count().where("count > 1")
    top = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    return top.column("h").to_numpy()[::-1].astype(np.int64), top.column("count").to_numpy()[::-1]


def prefixes(docs: DataFrame, last: np.ndarray, count: np.ndarray, shingle: int, least: float, text: str) -> DataFrame:
    """(h, v, n, i, hot): the shingles that a text of ``n`` shingles must be found by, those of ``last`` behind all others; ``hot`` where the sample has it in many texts."""
    at = np.argsort(last)
    known = docs.sparkSession.sparkContext.broadcast((last[at], at + 1, count[at] * SAMPLE > LARGE_CELL))

    def make(key: int, words: list[bytes]):
        values, ranks, many = known.value
        h = shingles(words, shingle)
        hot = np.zeros(len(h), bool)
        if len(values):
            k = np.minimum(np.searchsorted(values, h), len(values) - 1)
            by = np.lexsort((h, np.where(values[k] == h, ranks[k], 0)))
            h, hot = h[by], ((values[k] == h) & many[k])[by]
        size = len(h) - int(_least_of(len(h), least)) + 1
        return h[:size], np.full(size, key), np.full(size, len(h), np.int32), np.arange(size, dtype=np.int32), hot[:size]

    return _texts(docs, make, "h long, v long, n int, i int, hot boolean", text)


def _possible(n, i, m, j, least: float) -> np.ndarray:
    """Whether texts of ``n`` and ``m`` shingles that first meet at places ``i`` and ``j`` can be similar enough."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    return (low >= _least_of(high, least)) & (1 + np.minimum(n - i - 1, m - j - 1) >= _least_of(n + m, least / (1 + least)))


def cell_pairs(v: np.ndarray, n: np.ndarray, i: np.ndarray, least: float, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a cell's texts that may be similar, some at a time; with ``part`` only those of different parts."""
    by = np.lexsort((v, n))
    v, n, i = v[by], n[by].astype(np.int64), i[by].astype(np.int64)
    part = part[by] if part is not None else None
    top = np.searchsorted(_least_of(n, least), n, "right")  # the longer texts that are not too long
    rows_ = max(1, PAIRS // max(1, len(v)))
    for at in range(0, len(v), rows_):
        to = int(top[min(at + rows_, len(v)) - 1])
        own = slice(at, min(at + rows_, len(v)))
        good = _possible(n[own, None], i[own, None], n[None, at:to], i[None, at:to], least) & (v[own, None] != v[None, at:to])
        good &= np.arange(own.start, own.stop)[:, None] < np.arange(at, to)[None]
        if part is not None:
            good &= part[own, None] != part[None, at:to]
        x, y = np.nonzero(good)
        yield v[x + at], v[y + at]


def _whole_cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut between cells, whose key is the first ``keys`` columns."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
        same = np.ones(len(held[0]), bool)
        for k in held[:keys]:
            same &= k == k[-1]
        done = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if done:
            yield [x[:done] for x in held]
            held = [x[done:] for x in held]
    if held is not None:
        yield held


def _starts(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(new)))


def met(cells: DataFrame, least: float) -> DataFrame:
    """CELLS of (h, v, n, i, hot): kind 0 is a pair (a, b) to check; kind 1 a row (h, v, n, i) of a large cell. Hot rows are of large cells, and are dealt by their texts, not by ``h``."""
    names = [c.split()[0] for c in CELLS.split(", ")]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names)

    def pair_rows(a: np.ndarray, b: np.ndarray) -> tuple:
        zero = np.zeros(len(a), np.int32)
        return zero, a, b, zero, zero

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in _whole_cells(batches, 2):
            new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in rows_[:3]], axis=0)))  # a text that several tasks saw
            hot, h, v, n, i = (x[new] for x in rows_)
            hot = hot.astype(bool)
            if hot.any():
                yield batch_of([(np.ones(int(hot.sum()), np.int32), h[hot], v[hot], n[hot], i[hot])])
                h, v, n, i = (x[~hot] for x in (h, v, n, i))
            starts, sizes = _starts([h])
            two = starts[sizes == 2]
            two = two[_possible(n[two].astype(np.int64), i[two], n[two + 1].astype(np.int64), i[two + 1], least)]
            found, size = [pair_rows(v[two], v[two + 1])], 0
            for at, many in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = slice(at, at + many)
                if many > LARGE_CELL:
                    found.append((np.ones(many, np.int32), h[own], v[own], n[own], i[own]))
                else:
                    found += [pair_rows(a, b) for a, b in cell_pairs(v[own], n[own], i[own], least)]
                size += len(found[-1][0])
                if size > PAIRS:
                    yield batch_of(found)
                    found, size = [], 0
            if found:
                yield batch_of(found)

    by = F.when(F.col("hot"), F.xxhash64("v")).otherwise(F.col("h"))
    dealt = cells.select("hot", "h", "v", "n", "i").repartition(partitions(cells.sparkSession), by).sortWithinPartitions("hot", "h", "v")
    return dealt.mapInArrow(freed(run), CELLS)


def hub_pairs(large: DataFrame, least: float) -> DataFrame:
    """(a, b): each text (h, v, n, i, part) of large cells with two hubs of the cell, where they may be similar and are not joined. The hubs are those of the least hashes, so cells of like texts have like hubs."""
    hubs = large.groupBy("h").agg(*[F.min(F.struct(F.xxhash64("v", F.lit(k)).alias("o"), "v", "n", "i", "part")).alias(f"hub{k}") for k in range(2)])
    each = join_sums(large, hubs, ["h"]).select("v", "n", "i", "part", F.explode(F.array("hub0", "hub1")).alias("x")).where("part <> x.part")
    low, high = F.least("n", "x.n"), F.greatest("n", "x.n")
    fair = low >= F.ceil(high * F.lit(least) - 1e-9)
    reach = 1 + F.least(F.col("n") - F.col("i") - 1, F.col("x.n") - F.col("x.i") - 1) >= F.ceil((F.col("n") + F.col("x.n")) * F.lit(least / (1 + least)) - 1e-9)
    return each.where(fair & reach).select(F.col("v").alias("a"), F.col("x.v").alias("b"))


def part_pairs(large: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """(a, b): the pairs of large cells (h, v, n, i, part) that may be similar by lengths, places and bitmaps (v, bits) and are in different parts. A cell is dealt in blocks, each pair of which is a group of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in _whole_cells(batches, 3):
            starts, sizes = _starts(rows_[:3])
            for at, many in zip(starts.tolist(), sizes.tolist()):
                own = slice(at, at + many)
                _, low, high, v, n, i, part, block, bits_ = (x[own] for x in rows_)
                maps = np.concatenate(bits_).view(np.uint64).reshape(many, -1)
                n = n.astype(np.int64)
                for a, b in cell_pairs(np.arange(many), n, i, least, part):
                    apart = (block[a] != block[b]) | (low[0] == high[0])
                    a, b = a[apart], b[apart]
                    for k in range(0, len(a), COMPARED):
                        x, y = a[k : k + COMPARED], b[k : k + COMPARED]
                        differ = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)
                        fair = (n[x] + n[y] - differ) // 2 >= _least_of(n[x] + n[y], least / (1 + least))
                        if fair.any():
                            yield pa.RecordBatch.from_arrays([pa.array(v[x[fair]]), pa.array(v[y[fair]])], ["a", "b"])

    mixed = large.groupBy("h").agg(F.min("part").alias("_low"), F.max("part").alias("_high"), F.count("*").alias("m")).where("_low <> _high").select("h", "m")
    own = join_sums(large, mixed, ["h"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    own = own.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).join(bits, "v").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = own.repartition(partitions(large.sparkSession), "h", "low", "high").sortWithinPartitions("h", "low", "high")
    return dealt.select("h", "low", "high", "v", "n", "i", "part", "block", "bits").mapInArrow(freed(run), "a long, b long")


def similar(pairs: DataFrame, docs: DataFrame, shingle: int, least: float, text: str) -> DataFrame:
    """The distinct (u, v) of ``pairs`` (a, b) whose shingle sets have a similarity of ``least`` or more."""
    own = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    needed = own.select(F.col("a").alias("v")).union(own.select(F.col("b").alias("v"))).distinct()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([text_key(words_of(t.as_py())) for t in batch.column(0)], pa.int64()), batch.column(0)], ["v", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(words_of(t.as_py()), shingle) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["v", "h"])

    keyed = docs.select(F.col(text).alias("text")).mapInArrow(freed(keys), "v long, text string")
    few = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    sets = cut(keyed.join(few, "v", "left_semi").dropDuplicates(["v"]).mapInArrow(freed(run), "v long, h array<long>"))
    first = own.join(sets.select(F.col("v").alias("a"), F.col("h").alias("_a")), "a")
    both = first.join(sets.select(F.col("v").alias("b"), F.col("h").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.where(shared >= F.lit(least) * (F.size("_a") + F.size("_b") - shared) - 1e-9).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _roots(star: DataFrame) -> DataFrame:
    """(v, root) of the texts that a star (u, v) joins to a lesser one."""
    return star.select(F.col("u").alias("v"), F.col("v").alias("root"))


def _with_parts(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "v", "left").select(*rows.columns, F.coalesce("root", "v").alias("part"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The (a, b) that links have not joined."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("v").alias(c), F.col("root").alias(f"_{c}")), c, "left")
    return pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _fair(pairs: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """The (a, b) that may be similar by their numbers of shingles and their bitmaps (v, n, bits)."""
    pairs = pairs.where("a <> b")
    for c in ("a", "b"):
        pairs = pairs.join(bits.select(F.col("v").alias(c), F.col("n").alias(f"_n{c}"), F.col("bits").alias(f"_{c}")), c)
    differ = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("_na") + F.col("_nb")
    return pairs.where(F.floor((both - differ) / 2) >= F.ceil(both * F.lit(least / (1 + least)) - 1e-9)).select("a", "b")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, component_id, row, root) for each row: the smallest doc_id that pairs of a similarity of ``least`` or more reach.

    Words are lower-cased and stand between white space. Texts of the same words are one; those
    without words, or null, are all copies of each other. A null doc_id is never the smallest
    unless the component has no other. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column(1):  # the words of one text at a time
                words = words_of(t.as_py())
                hashes = shingle_hashes(words, shingle)
                made.append((text_key(words), majority(hashes), len(np.unique(hashes)), bitmap(hashes)))
            v, fps, n, bits = zip(*made) if made else ((), (), (), ())
            columns = [pa.array(v, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), batch.column(2), pa.array(n, pa.int32()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "v", "fp", "row", "n", "bits"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), row_key(text).alias("row"))
    rows = cut(own.mapInArrow(freed(run), "doc_id long, v long, fp long, row long, n int, bits array<long>"))

    # what anchors join: texts of one fingerprint with the first of them, and these with those of near fingerprints
    bits = cut(rows.groupBy("v").agg(F.first("n").alias("n"), F.first("bits").alias("bits")))
    first = rows.groupBy("fp").agg(F.min("v").alias("first"))
    same = join_sums(rows.select("v", "fp").distinct(), first, ["fp"]).select(F.col("v").alias("a"), F.col("first").alias("b"))
    near = links(at_anchors(first, THRESHOLD), THRESHOLD)
    near = near.join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v").select("a", "b")
    star = stars(similar(_fair(same.union(near), bits, least), docs, shingle, least, text))

    # what prefixes join besides
    found = cut(met(prefixes(docs, *frequent(docs, shingle, text), shingle, least, text), least))
    large = found.where("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("v"), "n", "i")
    roots = _roots(star)
    hubs = hub_pairs(_with_parts(large, roots), least)
    star = stars(star.union(similar(_fair(_apart(found.where("kind = 0").select("a", "b").union(hubs).distinct(), roots), bits, least), docs, shingle, least, text)))
    rest = part_pairs(_with_parts(large, _roots(star)), bits.drop("n"), least)
    star = stars(star.union(similar(rest, docs, shingle, least, text)))
    texts = rows.groupBy("v").agg(F.min("doc_id").alias("_least"))
    rooted = texts.join(star.select(F.col("u").alias("v"), F.col("v").alias("_root")), "v", "left").select("v", "_least", F.coalesce("_root", "v").alias("_root"))
    ids = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return rows.select("doc_id", "v", "row").join(rooted.join(ids, "_root").select("v", "component_id", F.col("_root").alias("root")), "v").select("doc_id", "component_id", "row", "root")
