import random

import brute
import pytest

import corpus_pipeline
from tessera.llm import similar, simhash


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


def near_rows(seed):
    rng = random.Random(seed)
    line = [f"line{k}" for k in range(30)]
    rows = []
    for _ in range(8):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 300))] + line
        rows += [changed(rng, words, len(words) * k // 200) for k in range(9)]
    return list(enumerate([*rows, " ".join(line), "one two", "One  TWO", "one two three", "", " ", None]))


@pytest.mark.parametrize("large", [2, 64])
def test_near_copies_of_five_words(docs, spark, data, monkeypatch, large):
    monkeypatch.setattr(similar, "LARGE_CELL", large)
    monkeypatch.setattr(similar, "BLOCK", 4 * large)
    rows = near_rows(large)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs(rows), data).collect()} == brute.near(rows)


def test_prefixes_alone_find_all(docs, spark, data, monkeypatch):
    """Without what SimHash joins, all pairs are left to the cells and their blocks."""
    monkeypatch.setattr(similar, "links", lambda cells, threshold: spark.createDataFrame([], "u long, v long"))
    monkeypatch.setattr(similar, "LARGE_CELL", 2)
    monkeypatch.setattr(similar, "BLOCK", 3)
    rows = near_rows(9)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs(rows), data).collect()} == brute.near(rows)


def test_stage_on_documents(spark, data):
    own = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in own.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, own, data).collect()} == brute.near(rows)


def test_near_copies_of_nothing(docs, spark, data):
    assert corpus_pipeline.near_duplicates(spark, docs([]), data).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")]
    assert [r["component_id"] for r in similar.near_copies(docs(rows)).collect()] == [3, 3, 3]


def test_one_doc_id_of_different_texts(docs, spark, data):
    texts = [" ".join(f"{w}{k}" for k in range(40)) for w in "abc"]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (5, texts[2]), (7, texts[1]), (7, texts[1])]
    want = [(1, texts[0]), (5, texts[1]), (5, texts[2])]
    assert sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs(rows), data).collect()) == want
    own = docs(rows)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each(own, simhash.near_duplicates(own)).collect()) == want
