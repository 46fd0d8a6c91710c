"""Language ID by a byte convolutional network, trained in numpy.

A window is 256 bytes. Bytes are embedded, filters of two, three and four bytes slide over the
window, each filter's largest response is kept, and a softmax over those gives the language. A
document's languages are the mean over all windows of its whole text, weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import freed, table

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8
#: The fit reads so many documents a language.
SAMPLE = 800
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the decimal doc_id leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class ByteCNN:
    """The network; ``labels`` are the languages in the order of its outputs."""

    def __init__(self, labels: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, self.reach = labels, max(WIDTHS)
        self.width = np.repeat(WIDTHS, FILTERS)
        n = len(self.width)
        self.embed = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embed[0] = 0
        self.taps = (np.arange(self.reach)[None, :] < self.width[:, None]).astype(np.float32)[:, :, None]
        self.kernel = rng.normal(0, 0.3, (n, self.reach, EMBEDDING)).astype(np.float32) * self.taps
        self.bias = np.zeros(n, np.float32)
        self.dense = rng.normal(0, 0.2, (n, len(labels))).astype(np.float32)
        self.shift = np.zeros(len(labels), np.float32)

    def pooled(self, windows: np.ndarray, where: bool = False):
        """The largest response of each filter in each window; with ``where`` its place too."""
        b, size = windows.shape
        flat = np.zeros((EMBEDDING, b * size + self.reach), np.float32)
        byte = windows.ravel()
        for e in range(EMBEDDING):
            np.take(np.ascontiguousarray(self.embed[:, e]), byte, out=flat[e, : b * size], mode="clip")
        rows = np.concatenate([flat[:, j : j + b * size] for j in range(self.reach)])
        out = (self.kernel.reshape(len(self.kernel), -1) @ rows).reshape(-1, b, size)
        best = np.empty((b, len(self.width)), np.float32)
        place = np.empty(best.shape, np.int64) if where else None
        for k, width in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            valid = out[own, :, : size - width + 1]
            if where:
                place[:, own] = valid.argmax(axis=2).T
            best[:, own] = valid.max(axis=2).T
        return np.maximum(best + self.bias, 0), place

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows)[0] @ self.dense + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, windows: np.ndarray, target: np.ndarray, steps: int = 600, batch: int = 64, rate: float = 0.01, seed: int = 1) -> ByteCNN:
        """Adam over whole passes of the windows, ``steps`` batches or the rest of that pass, at a rate that falls to nothing."""
        rng = np.random.default_rng(seed)
        a_pass = max(1, -(-len(windows) // batch))
        epochs = -(-steps // a_pass)
        names = ("embed", "kernel", "bias", "dense", "shift")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                x = windows[rows]
                act, place = self.pooled(x, where=True)
                z = act @ self.dense + self.shift
                z = np.exp(z - z.max(axis=1, keepdims=True))
                error = z / z.sum(axis=1, keepdims=True)
                error[np.arange(len(rows)), target[rows]] -= 1
                error /= len(rows)
                back = (error @ self.dense.T) * (act > 0)
                at_byte = np.minimum(place[:, :, None] + np.arange(self.reach), x.shape[1] - 1)
                bytes_ = x[np.arange(len(rows))[:, None, None], at_byte]
                grads = {
                    "dense": act.T @ error + 1e-4 * self.dense,
                    "shift": error.sum(axis=0),
                    "bias": back.sum(axis=0),
                    "kernel": np.einsum("bf,bfte->fte", back, self.embed[bytes_], optimize=True) * self.taps,
                }
                spread = (back[:, :, None, None] * self.kernel[None]).reshape(-1, EMBEDDING)
                own = bytes_.ravel()
                grads["embed"] = np.stack([np.bincount(own, spread[:, e], 256) for e in range(EMBEDDING)], axis=1).astype(np.float32)
                grads["embed"][0] = 0
                step += 1
                pace = rate * (1 - (step - 1) / (epochs * a_pass))
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    change = pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - change).astype(np.float32))
        return self


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all bytes of each text, the text each belongs to, and the bytes in each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // WINDOW)
    rows = np.zeros((int(counts.sum()), WINDOW), np.uint8)
    at = np.concatenate(([0], np.cumsum(counts)))
    flat = rows.ravel()
    for i, t in enumerate(texts):
        flat[at[i] * WINDOW : at[i] * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    used = np.minimum(WINDOW, sizes[owner] - (np.arange(len(owner)) - at[owner]) * WINDOW)
    return rows, owner, used


def training_windows(docs: DataFrame, sample: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Two windows of each of about ``sample`` documents a language, chosen by a hash of the doc_id; the driver gets ``3 * sample * 512`` bytes a language at most. Every language of the labels is learned."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    sizes = [(r[0], r[1]) for r in known.groupBy("lang").count().orderBy("lang").collect()]
    if not sizes:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = F.create_map(*[x for name, n in sizes for x in (F.lit(name), F.lit(min(1.0, sample / n)))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = known.where(draw < F.element_at(share, F.col("lang"))).select("doc_id", "lang", F.col("text").cast("binary").alias("b"))
    span = F.greatest(F.lit(1), F.length("b") - WINDOW)
    cuts = [F.substring("b", F.pmod(F.xxhash64(F.lit(i), "doc_id"), span).cast("int") + 1, F.lit(WINDOW)) for i in range(2)]
    rows = chosen.select("lang", *[c.alias(f"w{i}") for i, c in enumerate(cuts)]).limit(3 * sample * len(sizes)).collect()
    labels = sorted(name for name, _ in sizes)
    number, rng = {name: i for i, name in enumerate(labels)}, np.random.default_rng(seed)
    drawn = sorted((r[0], bytes(w)) for r in rows for w in r[1:] if w)
    out, target = np.zeros((len(drawn), WINDOW), np.uint8), np.array([number[name] for name, _ in drawn], np.int64)
    for i, (_, w) in enumerate(drawn):
        n = len(w) if rng.random() < 0.6 else min(len(w), int(rng.integers(12, WINDOW)))
        out[i, :n] = np.frombuffer(w[:n], np.uint8)
    return out, target, labels


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> ByteCNN:
    """The network learned from text and non-null lang of documents that aren't held out, ``sample`` a language at most."""
    windows, target, labels = training_windows(docs, sample, seed)
    net = ByteCNN(labels, seed)
    return net.fit(windows, target) if len(labels) > 1 else net


def predicted(docs: DataFrame, net: ByteCNN, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (text and what else there is) with a language and its score in columns of these names; the text alone decides.

    A null text, or one without a letter, is ``und`` with score 0; so is every text where nothing
    could be learned.
    """
    keep = [c for c in docs.columns if c not in names]
    kinds = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            best, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            group: list[tuple[int, bytes]] = []
            held = 0

            def flush() -> None:
                rows, owner, used = windows_of([t for _, t in group])
                total = np.zeros((len(group), len(net.labels)))
                for at in range(0, len(rows), 64):
                    np.add.at(total, owner[at : at + 64], net.probabilities(rows[at : at + 64]) * used[at : at + 64, None])
                total /= total.sum(axis=1, keepdims=True)
                for (i, _), p in zip(group, total):
                    best[i], score[i] = net.labels[int(p.argmax())], float(min(1.0, p.max()))

            for i, t in enumerate(texts):
                t = t.as_py()
                if net.labels and t and LETTER.search(t):
                    group.append((i, t.encode("utf-8", "replace")))
                    held += len(group[-1][1])
                    if held > 1 << 20:
                        flush()
                        group, held = [], 0
            if group:
                flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score)], [*batch.schema.names, *names])

    return docs.select(*keep).mapInArrow(freed(run), T.StructType([*kinds.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def identify(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row, learned from the rows that aren't held out.

    A row without a doc_id is not held out and not learned from; repeated rows have one answer each,
    and are learned from as often as they stand there. Empty table: no rows. Other columns may have any name.
    """
    net = fit(docs, sample, seed)
    return predicted(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have a letter and whose language scores ``least`` or more.

    Where nothing could be learned (no labelled rows) the score says nothing, and rows with a letter stay.
    """
    net = fit(docs, sample, seed)
    if len(net.labels) < 2:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = ("_tessera_language", "_tessera_score")
    return predicted(docs, net, names).where((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the language of every document."""
    return identify(table(spark, sf_dir, "documents"))
