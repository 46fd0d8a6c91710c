import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, tokenizing
from tessera.operators.summarizers import Lead
from tessera.plans import pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")
ROWS = [("train", 0, "Hello there, world!\nA second line of it.", "Hello"), ("train", 1, None, ""), ("train", 2, "word " * 50, "words and words")]
SCHEMA = "split string, row_idx long, dialogue string, summary string"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_features_are_the_librarys(spark, name):
    path = public_tokenizers.path(name)
    made = tokenizing.features(spark.createDataFrame(ROWS, SCHEMA), path, max_source=20, max_target=4)
    if name.endswith("json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        ids, eos = (lambda t: own.encode(t, add_special_tokens=False).ids), own.token_to_id("<|endoftext|>")
    else:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, eos = own.encode, own.eos_id()
    for r in made.collect():
        assert r["input_ids"] == [*ids(r["dialogue"] or "")[:19], eos] and r["labels"] == [*ids(r["summary"] or "")[:3], eos]
        assert r["attention_mask"] == [1] * len(r["input_ids"])
    back = {r[0]: r[1] for r in made.select("row_idx", tokenizing.decode(F.col("labels"), path)).collect()}
    assert back[0].strip() == "Hello" and back[1] == ""


def test_unknown_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="no tokenizer"):
        tokenizing.features(spark.createDataFrame(ROWS, SCHEMA), "some/checkpoint")


def test_a_metric_of_ones_own(spark):
    longest = lambda pairs: pairs.select("row_idx", F.struct(F.length("prediction").cast("double").alias("fmeasure")).alias("score"))
    made = evaluation.evaluate(spark.createDataFrame(ROWS, SCHEMA), Lead(1), "<n>", {"chars": longest})
    assert made.columns == ["chars"] and made.first()[0] == pytest.approx((19 + 0 + 250) / 3)


def test_checkpoints_are_known_by_their_config(spark, tmp_path, monkeypatch):
    (tmp_path / "config.json").write_text("{}")
    asked = []
    monkeypatch.setattr(pipeline, "Neural", lambda *a, **b: asked.append((a, b)) or "neural")
    assert pipeline.summarizer_of(spark, str(tmp_path), "tok", 4) == "neural" and asked == [((str(tmp_path), "tok"), {"batch": 4})]
    assert isinstance(pipeline.summarizer_of(spark, "x/lead"), Lead)
