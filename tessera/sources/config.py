"""Configuration: YAML files into frozen, typed records."""

from __future__ import annotations

import dataclasses
import os
import typing
from dataclasses import dataclass

import yaml


@dataclass(frozen=True)
class Ingestion:
    root_dir: str
    source_url: str
    local_data_file: str
    unzip_dir: str


@dataclass(frozen=True)
class Validation:
    root_dir: str
    status_file: str
    required: tuple[str, ...]
    data_dir: str = ""
    strict: bool = False


@dataclass(frozen=True)
class Transformation:
    root_dir: str
    data_path: str
    tokenizer: str
    max_source: int = 1024
    max_target: int = 128


@dataclass(frozen=True)
class Training:
    root_dir: str
    data_path: str
    model: str
    num_train_epochs: int = 1
    warmup_steps: int = 500
    batch_size: int = 1
    weight_decay: float = 0.01
    logging_steps: int = 10
    evaluation_strategy: str = "steps"
    eval_steps: int = 500
    save_steps: float = 1e6
    accumulation_steps: int = 16


@dataclass(frozen=True)
class Evaluation:
    root_dir: str
    data_path: str
    model_path: str
    tokenizer_path: str
    metric_file: str
    rows: int = 10
    batch_size: int = 2
    newline_token: str = "<n>"


def read_yaml(path: str) -> dict:
    """The file's tree; an empty file is an error."""
    with open(path, encoding="utf-8") as f:
        tree = yaml.safe_load(f)
    if not tree:
        raise ValueError(f"{path}: yaml file is empty")
    return tree


def coerced(kind: type, tree: dict, base: str = ""):
    """A record of ``kind`` from a tree, each value made the declared type (``1e6``, which YAML reads as text, becomes a number) or an error; unknown keys are errors.

    Names that end in _dir, _file or _path are taken from ``base`` if relative.
    """
    hints = typing.get_type_hints(kind)
    if unknown := set(tree) - set(hints):
        raise ValueError(f"{kind.__name__}: unknown {', '.join(sorted(unknown))}")
    out = {}
    for name, value in tree.items():
        want = hints[name]
        try:
            if want is bool:
                if not isinstance(value, bool):
                    raise ValueError("not a truth value")
            elif want is int:
                if float(value) != int(float(value)):
                    raise ValueError("not a whole number")
                value = int(float(value))
            elif want in (float, str):
                value = want(value)
            else:
                value = tuple(map(str, value))
        except (TypeError, ValueError) as e:
            raise ValueError(f"{kind.__name__}.{name}: {value!r}: {e}") from e
        if base and isinstance(value, str) and name.endswith(("_dir", "_file", "_path")) and value and "://" not in value:
            value = os.path.join(base, value)
        out[name] = value
    if missing := [f.name for f in dataclasses.fields(kind) if f.default is dataclasses.MISSING and f.name not in out]:
        raise ValueError(f"{kind.__name__}: {', '.join(missing)} missing")
    return kind(**out)


STAGES = {"ingestion": Ingestion, "validation": Validation, "transformation": Transformation, "training": Training, "evaluation": Evaluation}


class Configuration:
    """The records of all stages, read once. ``params`` (a second file) goes over the training section."""

    def __init__(self, path: str, params: str | None = None, base: str | None = None):
        self.base = os.path.abspath(base or os.path.dirname(path))
        tree = read_yaml(path)
        if params:
            tree["training"] = {**tree.get("training", {}), **read_yaml(params)}
        self.stages = {name: coerced(kind, tree[name], self.base) for name, kind in STAGES.items() if name in tree}

    def __getitem__(self, stage: str):
        return self.stages[stage]
