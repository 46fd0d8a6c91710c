import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import packing, queries


def test_stages_against_plain(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("key", F.lit(1))
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    names = docs.columns
    for (name, stage), check in zip(corpus_pipeline.STAGES[:4], ("language", "near", "substrings", "clean")):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        made = stage(spark, docs, data)
        assert made.columns == names, name
        rows = made.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(after) == len(rows) and all(r["key"] == 1 for r in rows)
        if check == "language":
            assert len(after) >= 0.97 * len(before) and all(after[k] == before[k] for k in after)
        if check == "near":
            assert set(after) == brute.near(sorted(before.items()))
        if check == "substrings":
            gone = {r[0]: r for r in brute.op10(sorted(before.items()))}
            assert set(after) == set(before)
            for k, t in after.items():
                assert t == before[k] if not gone[k][2] else len(brute.WORD.findall(t)) == gone[k][1] - gone[k][2]
            assert all(r["n_chars"] == len(r["text"]) for r in rows if gone[r["doc_id"]][2])
        if check == "clean":
            assert set(before) - set(after) == {k for k, _ in brute.op4(sorted(before.items()), items)}
        docs = spark.createDataFrame(rows, made.schema)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {packing.CAP}").count() == 0


def test_empty_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_odd_stages(spark, data, docs, odd):
    own = docs(odd)
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, own, data)
        assert made.columns == own.columns and made.count() <= own.count(), name
    assert corpus_pipeline.STAGES[4][1](spark, own, data).count() >= len(odd)


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(agrees, name):
    agrees(queries.QUERIES[name], queries.ORACLES[name])
