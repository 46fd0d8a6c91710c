import csv
import zipfile

import pytest
import yaml
from pyspark.sql import functions as F

from tessera.operators.summarizers import Lead
from tessera.plans import pipeline
from tessera.sources import archives, config, dialogues, schemas, sinks


def test_config(tmp_path):
    path, params = tmp_path / "config.yaml", tmp_path / "params.yaml"
    path.write_text(yaml.safe_dump({"training": {"root_dir": "train", "data_path": "/abs", "model": "tfidf"}, "validation": {"root_dir": "v", "status_file": "v/status.txt", "required": ["train"]}}))
    params.write_text("save_steps: 1e6\neval_steps: 500\nevaluation_strategy: steps\n")
    c = config.Configuration(str(path), str(params))
    assert c["training"].save_steps == 1e6 and c["training"].eval_steps == 500 and c["training"].evaluation_strategy == "steps"
    assert c["training"].root_dir == str(tmp_path / "train") and c["training"].data_path == "/abs"
    params.write_text("eval_steps: steps\n")
    with pytest.raises(ValueError, match="eval_steps"):
        config.Configuration(str(path), str(params))
    params.write_text("")
    with pytest.raises(ValueError, match="empty"):
        config.read_yaml(str(params))
    with pytest.raises(ValueError, match="unknown"):
        config.coerced(config.Training, {"x": 1})


def test_sizes(spark, tmp_path):
    df = spark.createDataFrame([(2560,), (3584,), (1,)], "n long")
    assert [r[0] for r in df.select(archives.size_kb(F.col("n"))).collect()] == ["~ 2 KB", "~ 4 KB", "~ 0 KB"]
    (tmp_path / "a.bin").write_bytes(b"x" * 3000)
    assert archives.file_sizes(spark, str(tmp_path)).first()["size"] == "~ 3 KB"


def test_fetch(tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    url, to = (tmp_path / "a").as_uri(), str(tmp_path / "to" / "b")
    assert archives.fetch(url, to) and not archives.fetch(url, to)
    with pytest.raises(OSError, match="length"):
        archives.fetch(url, to, length=4)


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "hello")
        z.writestr("y.txt", "")
    members = archives.zip_members(spark, str(tmp_path / "a.zip"))
    assert {(r["member"], bytes(r["content"])) for r in members.collect()} == {("d/x.txt", b"hello"), ("y.txt", b"")}
    assert archives.extract(members, str(tmp_path / "out")) == 2
    assert (tmp_path / "out/d/x.txt").read_text() == "hello"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError, match="leads out"):
        archives.extract(archives.zip_members(spark, str(tmp_path / "b.zip")), str(tmp_path / "out"))


def test_stages_stop_at_the_first_error(caplog):
    ran = []

    def fail():
        raise KeyError("no")

    with pytest.raises(KeyError):
        pipeline.run_stages([pipeline.Stage("a", lambda: ran.append(1)), pipeline.Stage("b", fail), pipeline.Stage("c", lambda: ran.append(2))])
    assert ran == [1] and "stage b failed" in caplog.text


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0.5, 1.0)], "a double, b double")
    sinks.write_single_csv(df, str(tmp_path / "x" / "m.csv"))
    assert list(csv.reader(open(tmp_path / "x" / "m.csv"))) == [["a", "b"], ["0.5", "1.0"]]
    with pytest.raises(ValueError, match="over 1"):
        sinks.write_single_csv(df.union(df), str(tmp_path / "n.csv"), most=1)
    sinks.write_csv(df, str(tmp_path / "dir"))
    assert spark.read.option("header", True).csv(str(tmp_path / "dir")).count() == 1


def test_whole_run(spark, data, tmp_path):
    raw = dialogues.dataset(spark.read.parquet(f"{data}/conversations.parquet")).select(*[f.name for f in schemas.RAW])
    dialogues.write_dataset(raw, str(tmp_path / "raw"))
    top = tmp_path / "raw"
    with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
        for f in top.rglob("*.parquet"):
            z.write(f, f.relative_to(top))
    tree = {
        "ingestion": {"root_dir": "in", "source_url": (tmp_path / "data.zip").as_uri(), "local_data_file": "in/data.zip", "unzip_dir": "in/set"},
        "validation": {"root_dir": "v", "data_dir": "in/set", "status_file": "v/status.txt", "required": ["split=train", "split=test", "split=validation"], "strict": True},
        "transformation": {"root_dir": "t", "data_path": "in/set", "tokenizer": "whitespace"},
        "training": {"root_dir": "m", "data_path": "t/dataset", "model": "tfidf"},
        "evaluation": {"root_dir": "e", "data_path": "t/dataset", "model_path": "m/model", "tokenizer_path": "t/vocabulary", "metric_file": "e/metrics.csv"},
    }
    (tmp_path / "config.yaml").write_text(yaml.safe_dump(tree))
    done = pipeline.run(spark, config.Configuration(str(tmp_path / "config.yaml")))
    assert list(done) == list(pipeline.STEPS) and done["validation"] is True
    assert (tmp_path / "v/status.txt").read_text() == "Validation status: True"
    head, row = csv.reader(open(tmp_path / "e/metrics.csv"))
    assert head == ["rouge1", "rouge2", "rougeL", "rougeLsum"] and all(0 <= float(x) <= 1 for x in row)
    plan = spark.read.parquet(str(tmp_path / "t/dataset")).where("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_predict_and_stream(spark, tmp_path):
    assert pipeline.predict(spark, "a\nb\nc", Lead(2)) == "a\nb"
    from tessera import streaming

    spark.createDataFrame([("x\ny\nz",)], "t string").write.parquet(str(tmp_path / "in"))
    stream = streaming.summaries(spark.readStream.schema("t string").parquet(str(tmp_path / "in")), "t")
    q = stream.writeStream.format("memory").queryName("summaries").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select prediction from summaries").first()[0] == "x\ny"
