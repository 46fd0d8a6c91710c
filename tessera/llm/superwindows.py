"""Finding windows of text that occur elsewhere, in Spark.

Consecutive windows that share their least k-gram (minimiser) form a run. Equal windows have
equal minimisers at equal places, so a window can only occur twice where its run's minimiser
does. The steps, all keyed by hashes and none of them over all pairs:

1. texts are dealt by document once; that exchange is read by each of the steps that follow.
   Whole copies of the text of a smaller doc_id are found by digest, and take part in the last
   step only,
2. minimisers are counted, a batch's before they are shuffled; runs whose minimiser occurs once
   are done with, the others go back to their document. Grams that a sample of the texts has often
   are a window's minimiser only where it has no other,
3. runs of a minimiser that is hot (more than HOT in the corpus) though the sample does not have it
   often are cut into single windows, which take step 2 again by a hash of the whole window,
4. super-windows (the text that a run's windows cover) travel to their minimiser's, or window's, bucket,
5. the bucket finds the windows that occur earlier, by sorting their content,
6. each document puts its windows together.

Hashes only choose who is compared with whom; what goes is always decided by content. So does the
sample: which grams are common is one table for all windows, so equal windows still have equal
minimisers. It is there since a passage that a third of all rows hold makes super-windows at its
edges that all differ and would all meet at the passage's minimisers; they have grams that reach
over the edge, which are rare, and meet at these, a run or two for each edge and not a row for each
window. Step 3 is for what the sample misses, such as a line that one document repeats. By itself, the passage gives a bucket as
many rows as there were batches: a batch sends one row of equal super-windows, marks those of
larger documents by itself, and notes the further places in one document beside the first.
Documents are known by doc_id and a hash of their text together, so that colliding hashes of
different doc_ids are told apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, freed, join_sums, partitions

#: A run as one long: its first window, the number of windows, and the minimiser's distance from the first.
COUNT_BITS = 8
LAST = (1 << 63) - 1
#: Runs of one minimiser in the corpus beyond which they are cut into single windows, and so share no bucket.
HOT = 2_000
#: The most frequent grams of the sample that are marked as common, in a table of so many slots, by their hashes' first bits.
COMMON, SLOTS = 100_000, 1 << 20
ID = ["doc_id", "key"]
LOW = np.uint64(0xFFFFFF)


def pack_run(start: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (start << 2 * COUNT_BITS) | (count << COUNT_BITS) | (anchor - start)


def unpack_run(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = run >> 2 * COUNT_BITS
    return start, (run >> COUNT_BITS) & 255, start + (run & 255)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


def runs_of(grams: np.ndarray, valid: np.ndarray, width: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, windows, minimiser's place and hash of each run. ``grams``: a hash for each place; ``valid``: which windows (of ``width`` grams) there are. At most 2**24 places.

    With a table ``common`` (1 in the slots of common grams) these come after all others, and the last bit of the hash says whether the minimiser is one.
    """
    none = np.zeros(0, np.int64)
    if len(grams) < width or not valid.any():
        return none, none, none, none.astype(np.uint64)
    order = grams
    if common is not None:
        marks = common[slot(grams)].astype(np.uint64)
        order = (grams >> np.uint64(1)) | (marks << np.uint64(63))
        grams = (grams & ~np.uint64(1)) | marks
    least = sliding_min((order & ~LOW) | np.arange(len(grams), dtype=np.uint64), width)
    at = np.flatnonzero(valid[: len(least)])
    own = least[at]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(new)
    anchor = (own[first] & LOW).astype(np.int64)
    return at[first], np.diff(np.append(first, len(at))), anchor, grams[anchor]


def joined(grams: np.ndarray, steps: list[int], n: int) -> np.ndarray:
    """A hash of the grams ``steps`` places on, for each of ``n`` places."""
    x = np.zeros(max(0, n), np.uint64)
    for k in steps:
        x = mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + grams[k : k + len(x)])
    return x


def rows(columns: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, k) for c, k in zip(columns, kinds)], names)


def text_hash(body: Column) -> Column:
    """With the doc_id, what a document is known by."""
    return F.xxhash64(body)


def _known(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, key, text) of each row: a null text is empty, a null doc_id comes after all others. Rows with one doc_id and text share doc_id and key."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), text_hash(body).alias("key"), body.alias("text"))


def dealt(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, text) by document: one exchange of the texts, which the steps share."""
    return _known(docs, text, doc_id).repartition(partitions(docs.sparkSession), *ID)


def copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key) of each row whose text a smaller doc_id has too. Digests are summed before they are shuffled, and texts stay where they are."""
    own = _known(docs, text, doc_id).select(*ID, F.unhex(F.sha2("text", 256)).alias("digest"))
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").select("digest", "first")
    return cut(join_sums(own, first, ["digest"]).where("doc_id > first").select(*ID).distinct())


def originals(texts: DataFrame, copied: DataFrame) -> DataFrame:
    # not an anti join: that would be pushed below the exchange of the texts, which then could not be shared
    marked = texts.join(copied.withColumn("_copied", F.lit(True)).hint("shuffle_hash"), ID, "left")
    return marked.where("_copied is null").select(*ID, "text")


def with_copies(removed: DataFrame, copied: DataFrame) -> DataFrame:
    """``removed`` and, for each copy, a mark that all its windows occur earlier."""
    whole = copied.select(*ID, F.array(F.struct(F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("count"))).alias("removed"))
    return removed.unionByName(whole)


def tally(source: DataFrame, scan: Callable[[pa.RecordBatch], Iterator[tuple]]) -> DataFrame:
    """(gram, m): how often a batch has each hash of ``scan``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, gram in scan(batch):
                own, m = np.unique(gram, return_counts=True)
                yield rows([own.view(np.int64), m], ["gram", "m"], [pa.int64()] * 2)

    return source.mapInArrow(freed(run), "gram long, m long")


def common_grams(docs: DataFrame, scan: Callable[[list[str]], Iterator[tuple]], grams: Callable[[str], np.ndarray], width: int) -> Broadcast | None:
    """The table for :func:`runs_of` of grams around minimisers that a sample of the different texts has often, or None if there are none.

    The sample has one text in ``share``, so that a minimiser of HOT runs is expected to be in it about 32 times; a quarter of that is often.
    """
    share = max(1, HOT // 32)
    often = max(2, HOT // (4 * share))
    sample = cut(_known(docs, "text", "doc_id").where(F.pmod("key", F.lit(share)) == 0).dropDuplicates(["key"]))

    def most(found: DataFrame) -> np.ndarray:
        top = found.groupBy("gram").agg(F.sum("m").alias("n")).where(F.col("n") >= often).orderBy(F.desc("n"), "gram").limit(COMMON).toArrow()
        return np.sort(top.column("gram").to_numpy())

    hot = most(tally(sample, lambda batch: scan(batch.column(2))))
    if not len(hot):
        return None
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def around(batch: pa.RecordBatch) -> Iterator[tuple]:
        values = known.value
        found = [(owner, run, gram.view(np.int64)) for owner, run, gram in scan(batch.column(2))]
        if not found:
            return
        owner, run, gram = (np.concatenate(x) for x in zip(*found))
        own = values[np.minimum(np.searchsorted(values, gram), len(values) - 1)] == gram
        owner, run = owner[own], run[own]
        for i in np.unique(owner).tolist():
            start, count, _ = unpack_run(run[owner == i])
            every = grams(batch.column(2)[i].as_py())
            yield None, None, every[spans(len(every), start, count, width)]

    table = np.zeros(SLOTS, np.uint8)
    table[slot(most(tally(sample, around)).view(np.uint64))] = 1
    return docs.sparkSession.sparkContext.broadcast(table)


def places(source: DataFrame, scan: Callable[[pa.RecordBatch], Iterator[tuple]]) -> DataFrame:
    """(gram, doc_id, key, run) of each run of ``scan``, which gives (row's number, packed run, hash) of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy() for k in (0, 1))
            for owner, packed_, gram in scan(batch):
                yield rows([gram.view(np.int64), ids[owner], keys[owner], packed_], ["gram", *ID, "run"], [pa.int64()] * 4)

    return source.mapInArrow(freed(run), "gram long, doc_id long, key long, run long")


def repeated(source: DataFrame, scan: Callable[[pa.RecordBatch], Iterator[tuple]]) -> DataFrame:
    """(gram, doc_id, key, run, n) of the runs whose hash occurs ``n`` > 1 times."""
    counts = tally(source, scan).groupBy("gram").agg(F.sum("m").alias("n")).where("n > 1")
    return join_sums(places(source, scan), counts, ["gram"], "shuffle_hash")


def of_documents(found: DataFrame) -> DataFrame:
    return found.groupBy(*ID).agg(F.collect_set(F.struct("run", "gram")).alias("runs"))


def candidates(texts: DataFrame, scan: Callable[[list[str]], Iterator[tuple]], window_hashes: Callable[[str], np.ndarray], marked: bool = False) -> DataFrame:
    """(doc_id, key, runs): of each document, the (run, gram) that another run shares; those of hot minimisers as single windows.

    ``marked``: the last bit of a gram says that it is common. Its runs hold common grams only, so few super-windows differ, and they stay whole.
    """

    def whole(batch: pa.RecordBatch) -> Iterator[tuple]:
        yield from scan(batch.column(2))

    def windows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, (text, pairs) in enumerate(zip(batch.column(2), batch.column(3))):
            start, count, anchor = unpack_run(np.sort(pairs.values.field(0).to_numpy()))
            at = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield np.full(len(at), i), pack_run(at, np.ones(len(at), np.int64), np.repeat(anchor, count)), window_hashes(text.as_py())[at]

    every = repeated(texts, whole)
    # one comparison: a condition on the gram alone would be pushed below exchanges, which could then not be shared
    many = F.col("n") * (1 - F.col("gram").bitwiseAND(F.lit(1)) if marked else F.lit(1)) > HOT
    hot = texts.join(of_documents(every.where(many)).hint("shuffle_hash"), ID).select(*ID, "text", "runs")
    found = every.where(~many).drop("n").unionByName(repeated(hot, windows).drop("n"))
    return of_documents(found)


PACKED = ["gram", *ID, "run", "body", "also"]
PACKED_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]


def packed(texts: DataFrame, found: DataFrame, cover: Callable[[str, np.ndarray], list[bytes]], within: bool) -> DataFrame:
    """PACKED of each repeated run: its super-window, made by ``cover(text, runs)``, and where else the document has it.

    ``within``: an earlier place in the same document counts. A super-window that an earlier row
    of the batch has is sent without a body: all its windows occur earlier. Such neighbours are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_pylist() for k in (0, 1))
            first: dict[tuple, tuple[int, int, int, list]] = {}
            done: set[tuple[int, int]] = set()
            out: list[list] = [[] for _ in PACKED]
            for i in sorted(range(batch.num_rows), key=ids.__getitem__):
                if (ids[i], keys[i]) in done:  # a repeated row: its document has been sent
                    continue
                done.add((ids[i], keys[i]))
                pairs = batch.column(3)[i].values
                run_, gram = (pairs.field(k).to_numpy() for k in range(2))
                by = np.argsort(run_, kind="stable")
                run_, gram = run_[by], gram[by]
                start, count, anchor = (x.tolist() for x in unpack_run(run_))
                bare = None
                for r, g, body, s, n, a in zip(run_.tolist(), gram.tolist(), cover(batch.column(2)[i].as_py(), run_), start, count, anchor):
                    also: list[int] = []
                    d, k, at, others = first.setdefault((body, a - s), (ids[i], keys[i], s, also))
                    if d < ids[i] or within and at < s:
                        if bare and bare[0] + bare[1] == s and bare[1] + n < 1 << COUNT_BITS:
                            bare[1] += n
                            out[3][bare[2]] = (bare[0] << 2 * COUNT_BITS) | (bare[1] << COUNT_BITS)
                            continue
                        bare = [s, n, len(out[0])]
                        r, body = (s << 2 * COUNT_BITS) | (n << COUNT_BITS), None
                    elif others is not also and k == keys[i]:
                        others.append(s)
                        continue
                    for column, value in zip(out, (g, ids[i], keys[i], r, body, also)):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield rows(out, PACKED, PACKED_KINDS)
                    out = [[] for _ in PACKED]
            if out[0]:
                yield rows(out, PACKED, PACKED_KINDS)

    return texts.join(found, ID).select(*ID, "text", "runs").mapInArrow(freed(run), "gram long, doc_id long, key long, run long, body binary, also array<long>")


def earlier(sent: DataFrame, find: Callable, most: int = 4 << 20) -> DataFrame:
    """(doc_id, key, removed): of each document the (start, count) of windows that occur earlier.

    ``find(gram, doc_id, run, bodies)`` gets whole buckets sorted by (gram, doc_id, run) and gives
    (row, start, count) of such windows. Buckets are put together up to ``most`` bytes.
    """
    spread = F.when(F.col("body").isNull(), F.xxhash64(*ID, "run")).otherwise(F.col("gram"))
    by = sent.withColumn("bucket", spread).repartition(partitions(sent.sparkSession), "bucket").sortWithinPartitions("bucket", "doc_id", "run")

    def settle(whole: pa.Table) -> pa.RecordBatch:
        has = np.array(whole.column("body").is_valid())
        ids, keys, runs = (whole.column(c).to_numpy() for c in (*ID, "run"))
        start, count, _ = unpack_run(runs[~has])
        got = [(ids[~has], keys[~has], start, count)]
        if has.any():
            own = whole.filter(pa.array(has))
            row, start, count = find(own.column("bucket").to_numpy(), ids[has], runs[has], own.column("body").to_pylist())
            got.append((ids[has][row], keys[has][row], start, count))
            lengths = pc.list_value_length(own.column("also")).to_numpy()
            if lengths.any():  # what goes at the first place goes at the others too
                n, begins = lengths[row], np.cumsum(lengths) - lengths
                other = pc.list_flatten(own.column("also")).to_numpy()[np.repeat(begins[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                step = start - unpack_run(runs[has][row])[0]
                got.append((np.repeat(ids[has][row], n), np.repeat(keys[has][row], n), other + np.repeat(step, n), np.repeat(count, n)))
        return rows([np.concatenate(x) for x in zip(*got)], [*ID, "start", "count"], [pa.int64()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            last = batch.column(0)[-1]
            if size < most or last == held[0].column(0)[0]:  # one bucket so far is not put together anew for each batch
                continue
            whole = pa.Table.from_batches(held)
            at = int(np.searchsorted(whole.column("bucket").to_numpy(), last.as_py()))
            yield settle(whole.slice(0, at))
            held = whole.slice(at).to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    found = by.select("bucket", *ID, "run", "body", "also").mapInArrow(freed(run), "doc_id long, key long, start long, count long")
    return found.groupBy(*ID).agg(F.collect_list(F.struct("start", "count")).alias("removed"))


def search(docs: DataFrame, scan: Callable, grams: Callable, width: int, window_hashes: Callable, cover: Callable, find: Callable, within: bool) -> tuple[DataFrame, DataFrame]:
    """The dealt texts, and (doc_id, key, removed) with the (start, count) of the windows that occur earlier; -1 for all of a copy. ``scan`` makes a scan with a table of common grams or None."""
    common = common_grams(docs, scan(None), grams, width)
    texts, copied = dealt(docs), copies(docs)
    own = originals(texts, copied)
    found = candidates(own, scan(common), window_hashes, common is not None)
    return texts, with_copies(earlier(packed(texts, found, cover, within), find), copied)


def apply(texts: DataFrame, removed: DataFrame, make: Callable[[str, np.ndarray, np.ndarray], tuple], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """doc_id and ``make(text, starts, counts)`` of every row of ``texts``; sentinel doc_ids are null again."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            made = []
            for text, gone in zip(batch.column(1), batch.column(2)):
                pairs = gone.values if gone.is_valid else None
                made.append(make(text.as_py(), *((pairs.field(k).to_numpy() for k in (0, 1)) if pairs is not None else (none, none))))
            yield rows([batch.column(0), *map(list, zip(*made))], ["doc_id", *names], [pa.int64(), *kinds])

    out = texts.join(removed, ID, "left").select("doc_id", "text", "removed").mapInArrow(run, f"doc_id long, {schema}")
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {LAST}L)"))


def spans(size: int, starts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Which of ``size`` places the windows at ``starts`` (``counts`` in a row each) cover; a copy loses all, if it has a window."""
    if len(starts) and starts[0] < 0:
        return np.full(size, size >= width)
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(size, starts + counts + width - 1), -1)
    return np.cumsum(edge[:-1]) > 0
