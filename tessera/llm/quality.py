"""Quality rules by an isolation forest on rule statistics.

The statistics of each document's whole text are made once. The forest's trees halve a random
feature at a random value of its range among labelled rows, and go on where good rows are left;
a row that few splits set apart from good rows is an anomaly. The score above which documents go
is calibrated on all labelled rows, from counts of a fixed number of score bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, table

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: More of the text, for the forest only.
EXTRA = ("n_lines", "n_upper", "n_letters", "n_marks", "n_distinct")
MIN_WORDS, MAX_REPEAT_SHARE = 50, 50
#: The fit reads about so many labelled rows of each quality, chosen by a hash; a tree so many good ones.
SAMPLE, TREES, TREE_SAMPLE, DEPTH = 4096, 100, 256, 12
#: At most this share of the good labelled rows may score above the threshold.
GOOD_LOSS = 0.005
BINS = 2000
SPACE, SYMBOLS, MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"!?{}[]=~^_\\@"
UPPER, LETTERS = bytes(range(0x41, 0x5B)), bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)])


def repeat_words(words: list[bytes]) -> int:
    """Words within three-word windows that occur twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    count = Counter(windows)
    covered = np.zeros(len(words), bool)
    here = np.fromiter((count[w] > 1 for w in windows), bool, n)
    for k in range(3):
        covered[k : n + k] |= here
    return int(covered.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """STATISTICS and EXTRA of one text; a null text has none of anything."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    count = lambda of: len(raw) - len(raw.translate(None, of))
    seen: set[bytes] = set()
    dup = full = 0
    for line in raw.split(b"\n"):
        if line.strip(SPACE):
            full += 1
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - count(SPACE), count(SYMBOLS), dup, repeat_words(words), full, count(UPPER), count(LETTERS), count(MARKS), len(set(words))


def with_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, STATISTICS and EXTRA of each row."""
    names = [*STATISTICS, *EXTRA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([statistics(t.as_py()) for t in batch.column(1)], np.int64).reshape(batch.num_rows, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in made.T)], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in names)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def features(s: np.ndarray) -> np.ndarray:
    """What the forest splits on, from rows of STATISTICS and EXTRA: shares and means, roots of those with long tails."""
    f = dict(zip((*STATISTICS, *EXTRA), s.astype(np.float64).T))
    words, lines, letters = (np.maximum(1, f[k]) for k in ("n_words", "n_lines", "n_letters"))
    shares = [f["n_symbols"] / words, f["n_dup_lines"] / lines, f["n_repeat_words"] / words, f["n_upper"] / letters, f["n_marks"] / words]
    return np.stack([*(np.sqrt(np.minimum(4, x)) for x in shares), np.minimum(30, f["word_chars"] / words), f["n_distinct"] / words**0.9], axis=1)


def average_path(n: float) -> float:
    """The mean path of an unsuccessful search among n values: what a leaf of n rows stands for."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class IsolationForest:
    """Trees as arrays: feature (-1 at a leaf), split, children, and at leaves the path's length.

    ``rows`` are the rows that trees isolate, ``span`` (lowest, highest) the range that splits come from.
    """

    def __init__(self, rows: np.ndarray, span: tuple[np.ndarray, np.ndarray], trees: int = TREES, sample: int = TREE_SAMPLE, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], span, rng) for _ in range(trees if len(rows) else 0)]

    @staticmethod
    def _grow(rows: np.ndarray, span: tuple[np.ndarray, np.ndarray], rng: np.random.Generator):
        tree: list[list] = []

        def node(own: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
            at = len(tree)
            tree.append([-1, 0.0, 0, 0, depth + average_path(len(own))])
            open_ = np.flatnonzero(high - low > 1e-9)
            if depth < DEPTH and len(own) > 1 and len(open_):
                k = int(rng.choice(open_))
                split = float(rng.uniform(low[k], high[k]))
                below, above = high.copy(), low.copy()
                below[k] = above[k] = split
                under = own[:, k] <= split
                tree[at][:4] = [k, split, node(own[under], low, below, depth + 1), node(own[~under], above, high, depth + 1)]
            return at

        node(rows, *span, 0)
        return tuple(np.array(c) for c in zip(*tree))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; nearer 1 the fewer splits set the row apart. 0 without trees."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, left, right, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                low = rows[every, np.maximum(feature[at], 0)] <= split[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += length[at]
        return np.exp2(-total / len(self.trees) / max(1.0, average_path(self.sample)))


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11) -> IsolationForest:
    """A forest of good labelled rows (quality 1), its splits in the range of all labelled rows drawn; about ``sample`` rows of each quality come to the driver."""
    names = [*STATISTICS, *EXTRA]
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    sizes = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    share = F.when(F.col("quality") == 1, sample / max(1, sizes.get(1, 0))).otherwise(sample / max(1, sizes.get(0, 0)))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / (1 << 20) < share)
    rows = stats.join(drawn, "doc_id").select("quality", *names).limit(4 * sample).collect()
    made = np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, len(names) + 1)
    if not len(made):
        return IsolationForest(np.zeros((0, 1)), (np.zeros(1), np.zeros(1)))
    own = features(made[:, 1:])
    return IsolationForest(own[made[:, 0] == 1], (own.min(axis=0), own.max(axis=0)), seed=seed)


def scored(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """``stats`` (doc_id, STATISTICS, EXTRA) with anomaly, the forest's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(1, batch.num_columns)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(features(rows)))], [*batch.schema.names, "anomaly"])

    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, T.StructField("anomaly", T.DoubleType())]))


def threshold(scores: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS) -> float:
    """The lowest score above which at most ``good_loss`` of all good labelled rows lie; 1 (nothing goes) without good and bad rows.

    If bad rows all lie lower, a lower threshold would cost more good rows than allowed, so it stays.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    binned = scores.join(known, "doc_id").groupBy(F.ceil(F.col("anomaly") * BINS).alias("bin"), "quality").count().collect()
    count = np.zeros((2, BINS + 1), np.int64)
    for k, quality, n in binned:
        count[int(quality), min(BINS, int(k))] += n
    if not count[0].sum() or not count[1].sum():
        return 1.0
    above = np.cumsum(count[:, ::-1], axis=1)[:, ::-1]
    bad = above[0] / count[0].sum()
    good = above[1] / count[1].sum()
    fair = np.flatnonzero(good <= good_loss)
    if not len(fair):
        return 1.0
    gain = bad[fair] - good[fair]
    return float(fair[np.flatnonzero(gain == gain.max())[-1]] - 1) / BINS


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, good_loss: float = GOOD_LOSS) -> DataFrame:
    """doc_id, STATISTICS, base_failed, anomaly and kept of each row of ``docs``.

    A null or empty text has no words and fails the base rule. Labels without a doc_id or with a
    quality other than 0 and 1 are not used; a document labelled twice counts twice. Without
    labels the base rule alone decides. An empty table gives no rows.
    """
    stats = cut(with_statistics(docs))
    forest = fit(stats, labels, sample)
    scores = cut(scored(stats, forest))
    limit = threshold(scores, labels, good_loss)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    return scores.select("doc_id", *STATISTICS, failed.alias("base_failed"), "anomaly").withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= limit))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the statistics and the verdict of every document."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
