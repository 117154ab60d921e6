"""Settings of training and matching, checked when made."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any


def _whole(least: int):
    return lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= least


def _real(low: float, high: float = math.inf, *, open_low: bool = False, open_high: bool = False):
    def ok(v: Any) -> bool:
        number = isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
        return number and (low < v if open_low else low <= v) and (v < high if open_high else v <= high)

    return ok


class SettingTypeError(TypeError, ValueError):
    """A setting of a wrong type, which is no valid value either."""


@dataclass(frozen=True)
class MatcherConfig:
    """Values of a wrong type raise SettingTypeError (a TypeError), values out of their range ValueError."""

    # names and defaults of the public configuration (fixed values)
    seed: int = 42
    max_length: int = 64
    char_embedding_dim: int = 32
    cnn_channels: int = 64
    cnn_kernel_sizes: tuple[int, ...] = (2, 3, 4, 5)
    field_embedding_dim: int = 128
    classifier_hidden_dim: int = 256
    classifier_second_hidden_dim: int = 64
    embedding_epochs: int = 15
    classifier_epochs: int = 15
    batch_size: int = 256
    inference_batch_size: int = 512
    learning_rate: float = 0.001
    classifier_learning_rate: float = 0.001
    weight_decay: float = 0.0001
    cosine_margin: float = 0.2
    dropout: float = 0.2
    early_stopping_patience: int = 3
    early_stopping_min_delta: float = 0.0
    fine_tune_encoder: bool = False
    random_negatives_per_positive: int = 1
    hard_negatives_per_positive: int = 1
    hard_negative_pool_size: int = 100
    synthetic_negative_weight: float = 1.0
    top_k: int = 10
    review_threshold: float = 0.80
    auto_accept_threshold: float = 0.95
    retrieval_chunk_size: int = 4096
    num_workers: int = 0
    torch_num_threads: int = 8

    def __post_init__(self) -> None:
        for field in fields(self):
            value, kind = getattr(self, field.name), type(field.default)
            if kind is bool:
                right = isinstance(value, bool)
            elif kind is tuple:
                right = isinstance(value, (list, tuple))
            else:  # a whole number also stands for a real one
                right = isinstance(value, int if kind is int else (int, float)) and not isinstance(value, bool)
            if not right:
                raise SettingTypeError(f"{field.name} has the wrong type: {value!r}")
        sizes = self.cnn_kernel_sizes
        if not sizes or not all(map(_whole(1), sizes)):
            raise ValueError("cnn_kernel_sizes must be positive whole numbers")
        object.__setattr__(self, "cnn_kernel_sizes", tuple(sizes))
        for name, ok in _RULES.items():
            if not ok(getattr(self, name)):
                raise ValueError(f"{name} is out of its range: {getattr(self, name)!r}")
        if self.max_length < max(sizes):
            raise ValueError("max_length must not be below the largest kernel")
        if self.auto_accept_threshold < self.review_threshold:
            raise ValueError("auto_accept_threshold must not be below review_threshold")

    @classmethod
    def from_dict(cls, values: Mapping[str, Any]) -> MatcherConfig:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)

    @classmethod
    def load(cls, path: str | Path) -> MatcherConfig:
        values = json.loads(Path(path).read_text(encoding="utf-8-sig"))
        if not isinstance(values, dict):
            raise ValueError("settings must be a JSON object")
        return cls.from_dict(values)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self) | {"cnn_kernel_sizes": list(self.cnn_kernel_sizes)}

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2, allow_nan=False) + "\n", encoding="utf-8")


_RULES = {
    **dict.fromkeys(("seed", "early_stopping_patience", "random_negatives_per_positive", "hard_negatives_per_positive", "num_workers"), _whole(0)),
    **dict.fromkeys(
        (
            "max_length", "char_embedding_dim", "cnn_channels", "field_embedding_dim", "classifier_hidden_dim", "classifier_second_hidden_dim", "embedding_epochs", "classifier_epochs",
            "batch_size", "inference_batch_size", "hard_negative_pool_size", "top_k", "retrieval_chunk_size", "torch_num_threads",
        ),
        _whole(1),
    ),
    **dict.fromkeys(("learning_rate", "classifier_learning_rate"), _real(0, open_low=True)),
    **dict.fromkeys(("weight_decay", "early_stopping_min_delta"), _real(0)),
    **dict.fromkeys(("review_threshold", "auto_accept_threshold"), _real(0, 1)),
    "cosine_margin": _real(-1, 1),
    "dropout": _real(0, 1, open_high=True),
    "synthetic_negative_weight": _real(0, 1, open_low=True),
}
