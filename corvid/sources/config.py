"""Configuration files, read by the driver; YAML needs PyYAML."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace
from functools import lru_cache

from corvid.operators.hybrid import Config, Weights


def read_yaml(path: str | None) -> dict:
    """A file's mapping; empty without a file or where it holds no mapping."""
    import yaml

    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    return found if isinstance(found, dict) else {}


@dataclass(frozen=True)
class Embedding:
    """The model that embeds, and what goes before its passages and queries."""

    name: str = ""
    dimension: int = 1024
    passage_prefix: str = "passage: "
    query_prefix: str = "query: "


def embedding_config(path: str | None, model: str | None = None) -> Embedding:
    """A model of the file's ``models``, the default one if none is named; ValueError if it isn't there."""
    found = read_yaml(path)
    models, key = found.get("models") or {}, model or found.get("default_model")
    if not key:
        return Embedding()
    if key not in models:
        raise ValueError(f"unknown embedding model {key!r}; known: {', '.join(sorted(models))}")
    entry = models[key]
    known = {k: v for k, v in entry.items() if k in Embedding.__dataclass_fields__}
    return Embedding(**known)


def hybrid_config(path: str | None, weights: Weights = Weights()) -> Config:
    """The file's ``reranker`` section; an unknown default model keeps the built-in name."""
    entry = read_yaml(path).get("reranker") or {}
    model = (entry.get("models") or {}).get(entry.get("default_model")) or {}
    base = Config()
    return Config(
        weights=replace(weights, rerank=entry.get("weight", weights.rerank)),
        rerank_enabled=entry.get("enabled", base.rerank_enabled),
        rerank_candidates=entry.get("candidates", base.rerank_candidates),
        rerank_top_k=entry.get("top_k", base.rerank_top_k),
        rerank_model=model.get("name", base.rerank_model),
        rerank_batch_size=entry.get("batch_size", base.rerank_batch_size),
        rerank_max_length=model.get("max_seq_length"),
    )


@dataclass(frozen=True)
class Evaluation:
    """Settings of an evaluation; environment variables ``CORVID_<NAME>`` go before the file."""

    dataset_path: str = ""
    validate: bool = True
    limit: int = 0
    judge_provider: str = ""
    judge_model: str = ""
    use_judge: bool = False
    judge_pairs: dict[str, str] = field(default_factory=dict)


def evaluation_config(path: str | None, environ: dict[str, str] | None = None) -> Evaluation:
    found, env = read_yaml(path), os.environ if environ is None else environ
    values = {k: v for k, v in found.items() if k in Evaluation.__dataclass_fields__}
    for name, kind in Evaluation.__dataclass_fields__.items():
        given = env.get(f"CORVID_{name.upper()}")
        if given is not None and name != "judge_pairs":
            default = kind.default
            values[name] = given.lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else int(given) if isinstance(default, int) else given
    return Evaluation(**values)


@lru_cache(4)
def shared_evaluation_config(path: str | None) -> Evaluation:
    """The same object for the same path, read once a process."""
    return evaluation_config(path)
