import pytest
from pyspark.sql import functions as F

from tessera.operators import features, selection, validation
from tessera.operators.indexing import dense_index
from tessera.operators.summarizers import Lead, Neural, TfIdf

REQUIRED = ["train", "test", "validation"]


@pytest.mark.parametrize(
    ("names", "compat", "strict"),
    [(["train", "extra"], False, False), (["extra", "train"], True, False), (["train"], True, False), ([], None, None), (["validation", "test", "train"], True, True)],
)
def test_validation(spark, names, compat, strict):
    entries = spark.createDataFrame(list(zip(names, range(len(names)))), "name string, ord int")
    assert validation.status_compat(entries, REQUIRED).first()[0] is compat
    assert validation.status_strict(entries, REQUIRED).first()[0] is strict
    assert {r[0] for r in validation.missing(entries, REQUIRED).collect()} == set(REQUIRED) - set(names)


def test_status_text():
    assert validation.status_text(None) is None
    assert validation.status_text(True) == "Validation status: True"


def test_batches(spark):
    df = spark.createDataFrame([("test", i, f"t{i}") for i in range(5)], "split string, row_idx long, text string")
    got = {r["batch_id"]: r["text"] for r in selection.batches(df.repartition(3), 2, ["text"]).collect()}
    assert got == {0: ["t0", "t1"], 1: ["t2", "t3"], 2: ["t4"]}
    assert selection.batch_counts(df, 2).first()["batches"] == 3
    assert selection.first_rows(df, 2).count() == 2
    assert selection.row(df, 3).first()["text"] == "t3"


def test_dense_index(spark):
    df = spark.createDataFrame([("a", x) for x in range(50, 0, -1)] + [("b", 7)], "g string, x int")
    got = {(r["g"], r["x"]): r["i"] for r in dense_index(df.repartition(7), ["x"], ["g"], "i").collect()}
    assert got == {("a", x): x - 1 for x in range(1, 51)} | {("b", 7): 0}
    assert dense_index(df.limit(0), ["x"], ["g"], "i").count() == 0


def test_features(spark):
    rows = [("train", 0, "a b a c", "a"), ("train", 1, "", "zz b"), ("test", 0, "q a", None)]
    df = spark.createDataFrame(rows, "split string, row_idx long, dialogue string, summary string")
    vocab = features.vocabulary(selection.split(df, "train"), ["dialogue", "summary"])
    assert {r[0]: r[1] for r in vocab.collect()} == {"a": 3, "b": 4, "c": 5, "zz": 6}
    made = {(r["split"], r["row_idx"]): r for r in features.features(df, vocab, max_source=3, max_target=2).collect()}
    assert made["train", 0]["input_ids"] == [3, 4, 1] and made["train", 0]["labels"] == [3, 1] and made["train", 0]["attention_mask"] == [1, 1, 1]
    assert made["train", 1]["input_ids"] == [1] and made["train", 1]["labels"] == [6, 1]
    assert made["test", 0]["input_ids"] == [2, 3, 1] and made["test", 0]["labels"] == [1]
    both = features.features(df, vocab)
    lengths = {(r["split"], r["row_idx"]): (len(r["input_ids"]), sum(r["attention_mask"]), len(r["labels"])) for r in features.collated(both, 2).collect()}
    assert lengths == {("train", 0): (5, 5, 3), ("train", 1): (5, 1, 3), ("test", 0): (3, 3, 1)}
    back = {(r["split"], r["row_idx"]): r["text"] for r in features.decode(both, "input_ids", vocab).collect()}
    assert back == {("train", 0): "a b a c", ("train", 1): "", ("test", 0): "a"}


def test_summarizers(spark, tmp_path):
    df = spark.createDataFrame([("train", 0, "the a\nthe zebra ran\nthe a b\nthe"), ("train", 1, "the a"), ("train", 2, None)], "split string, row_idx long, dialogue string")
    lead = {r["row_idx"]: r["prediction"] for r in Lead(2).summarize(df, "dialogue").collect()}
    assert lead == {0: "the a\nthe zebra ran", 1: "the a", 2: ""}
    TfIdf.fit(df, "dialogue").save(str(tmp_path / "m"))
    best = {r["row_idx"]: r["prediction"] for r in TfIdf.load(spark, str(tmp_path / "m")).summarize(df, "dialogue").collect()}
    assert best == {0: "the zebra ran\nthe a b", 1: "the a", 2: ""}


def test_neural_says_what_it_needs():
    pytest.importorskip("pyspark")
    try:
        import transformers  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="transformers"):
            Neural("x")


def test_filters_reach_the_scan(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet").where(F.col("conv_id") == 1).select("text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(conv_id,1)" in plan and "role" not in plan
