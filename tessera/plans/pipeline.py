"""Stages that run one after the other, and the summarization pipeline made of them."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, features, selection, tokenizing, validation
from ..operators.summarizers import Lead, Neural, Summarizer, TfIdf
from ..sources import archives, dialogues, schemas, sinks
from ..sources.config import Configuration

log = logging.getLogger(__name__)
#: The setting that stands for a vocabulary of white-space words in place of a tokenizer's file.
WORDS = "whitespace"


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[], object]


def run_stages(stages: list[Stage]) -> dict[str, object]:
    """What each stage returned. The first error is logged, ends the run and is raised."""
    done: dict[str, object] = {}
    for stage in stages:
        log.info("stage %s started", stage.name)
        try:
            done[stage.name] = stage.run()
        except Exception:
            log.exception("stage %s failed", stage.name)
            raise
        log.info("stage %s completed", stage.name)
    return done


def log_to(path: str) -> None:
    """Sends this package's log to a file and to the console, in one format; only when called."""
    import sys

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    form = logging.Formatter("[%(asctime)s: %(levelname)s: %(module)s: %(message)s]")
    for handler in (logging.FileHandler(path), logging.StreamHandler(sys.stdout)):
        handler.setFormatter(form)
        logging.getLogger("tessera").addHandler(handler)
    logging.getLogger("tessera").setLevel(logging.INFO)


def ingest(spark: SparkSession, config) -> int:
    archives.fetch(config.source_url, config.local_data_file)
    return archives.extract(archives.zip_members(spark, config.local_data_file), config.unzip_dir)


def validate(spark: SparkSession, config) -> bool | None:
    """The status, also written to the status file if there is one; in strict mode anything but True is an error."""
    entries = archives.listing(spark, config.data_dir or config.root_dir)
    check = validation.status_strict if config.strict else validation.status_compat
    status = check(entries, list(config.required)).first()[0]
    if (text := validation.status_text(status)) is not None:
        sinks.write_text(config.status_file, text)
    if config.strict and not status:
        raise ValueError(f"{config.data_dir or config.root_dir} does not hold just {', '.join(config.required)}")
    return status


def transform(spark: SparkSession, config) -> str:
    """Stores raw and feature columns of all splits. ``tokenizer`` is a tokenizer's file, or ``whitespace`` for a vocabulary made from the train split and stored too; anything else is an error."""
    data = dialogues.read_dataset(spark, config.data_path)
    caps = {"max_source": config.max_source, "max_target": config.max_target}
    if config.tokenizer == WORDS:
        path = f"{config.root_dir}/vocabulary"
        features.vocabulary(selection.split(data, "train"), ["dialogue", "summary"]).write.mode("overwrite").parquet(path)
        made = features.features(data, spark.read.parquet(path), **caps)
    else:
        made = tokenizing.features(data, config.tokenizer, **caps)
    dialogues.write_dataset(made.select(*[f.name for f in schemas.FEATURES]), f"{config.root_dir}/dataset")
    return f"{config.root_dir}/dataset"


def train(spark: SparkSession, config) -> str:
    """Fits the extractive model on the train split alone and stores it. ``model: neural`` names a checkpoint to fine-tune, for which torch is needed."""
    data = dialogues.read_dataset(spark, config.data_path, schemas.FEATURES)
    if config.model != "tfidf":
        return fine_tune(*(selection.model_inputs(selection.split(data, s)) for s in ("train", "validation")), config)
    TfIdf.fit(selection.split(data, "train"), "dialogue").save(f"{config.root_dir}/model")
    return f"{config.root_dir}/model"


def fine_tune(inputs: DataFrame, validation_inputs: DataFrame, config) -> str:
    """Fine-tunes a checkpoint on ``inputs`` in one process by TorchDistributor, evaluating on the others, with the configured rates, steps and accumulation. Rows are read from Parquet one at a time."""
    try:
        import torch  # noqa: F401
        import transformers  # noqa: F401
    except ImportError as e:
        raise RuntimeError("fine-tuning needs torch and transformers, which are not installed") from e
    from pyspark.ml.torch.distributor import TorchDistributor

    paths = [f"{config.root_dir}/{name}" for name in ("inputs", "validation_inputs")]
    for df, path in zip((inputs, validation_inputs), paths):
        df.write.mode("overwrite").parquet(path)

    def work(paths: list[str], options: dict, model: str, root: str) -> str:
        import pyarrow.dataset as ds
        from torch.utils.data import Dataset
        from transformers import AutoModelForSeq2SeqLM, AutoTokenizer, DataCollatorForSeq2Seq, Trainer, TrainingArguments

        tokenizer, net = AutoTokenizer.from_pretrained(model), AutoModelForSeq2SeqLM.from_pretrained(model)

        class Rows(Dataset):
            def __init__(self, path: str):
                self.rows = ds.dataset(path)
                self.n = self.rows.count_rows()

            def __len__(self) -> int:
                return self.n

            def __getitem__(self, i: int) -> dict:
                return self.rows.take([i]).to_pylist()[0]

        own, other = map(Rows, paths)
        trainer = Trainer(model=net, args=TrainingArguments(**options), data_collator=DataCollatorForSeq2Seq(tokenizer, model=net), train_dataset=own, eval_dataset=other)
        trainer.train()
        net.save_pretrained(f"{root}/model")
        tokenizer.save_pretrained(f"{root}/tokenizer")
        return f"{root}/model"

    options = {
        "output_dir": config.root_dir, "num_train_epochs": config.num_train_epochs, "warmup_steps": config.warmup_steps, "per_device_train_batch_size": config.batch_size, "weight_decay": config.weight_decay,
        "logging_steps": config.logging_steps, "save_steps": int(config.save_steps), "gradient_accumulation_steps": config.accumulation_steps,
        "eval_strategy": config.evaluation_strategy, "eval_steps": config.eval_steps,
    }
    return TorchDistributor(num_processes=1, local_mode=True, use_gpu=False).run(work, paths, options, config.model, config.root_dir)


def summarizer_of(spark: SparkSession, model_path: str, tokenizer_path: str | None = None, batch_size: int = 2) -> Summarizer:
    """By what is stored there: the first lines (a path that ends in ``lead``), a fine-tuned checkpoint (a folder with a config.json), else TF-IDF frequencies."""
    if model_path.endswith("lead"):
        return Lead()
    if os.path.exists(f"{model_path}/config.json"):
        return Neural(model_path, tokenizer_path, batch=batch_size)
    return TfIdf.load(spark, model_path)


def evaluate(spark: SparkSession, config) -> str:
    """The metrics of the first rows of the test split, in a CSV file of one row."""
    data = selection.first_rows(selection.split(dialogues.read_dataset(spark, config.data_path, schemas.FEATURES), "test"), config.rows)
    sinks.write_single_csv(evaluation.evaluate(data, summarizer_of(spark, config.model_path, config.tokenizer_path, config.batch_size), config.newline_token), config.metric_file)
    return config.metric_file


STEPS = {"ingestion": ingest, "validation": validate, "transformation": transform, "training": train, "evaluation": evaluate}


def run(spark: SparkSession, config: Configuration) -> dict[str, object]:
    """All stages that the configuration has, in order."""
    return run_stages([Stage(name, lambda name=name: STEPS[name](spark, config[name])) for name in STEPS if name in config.stages])


def predict(spark: SparkSession, text: str, summarizer: Summarizer) -> str:
    """The summary of one text, by the same path as tables take; newline tokens are left as they are."""
    one = spark.range(1).select(F.lit("predict").alias("split"), F.lit(0).cast("long").alias("row_idx"), F.lit(text).alias("dialogue"))
    return summarizer.summarize(one, "dialogue").select("prediction").first()[0]
