"""Run settings and ``key=value`` overrides."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any

from .operators.encode import EncodeConfig
from .train import TrainConfig


@dataclass(frozen=True)
class AnnotateConfig:
    """An annotation run; metrics need ``compute_metrics``, ``return_true_annotation`` and ``label_file`` together."""

    input: str = ""
    index: str = ""
    store: str | None = None
    head: str | None = None
    label_file: str | None = None
    output_dir: str = "."
    k: int = 1
    distance_cutoff: float = 1.0
    batch_size: int = 8192
    strategy: str = "auto"
    return_true_annotation: bool = False
    return_distance: bool = True
    return_confidence: bool = False
    compute_metrics: bool = False
    num_thresholds: int = 50
    #: One TSV file per input, streamed through the driver, instead of a folder of parts.
    single_file: bool = False
    structure_dir: str | None = None
    aligner: str = "TMalign"
    encode: EncodeConfig = field(default_factory=EncodeConfig)


@dataclass(frozen=True)
class IndexConfig:
    """An index build."""

    input: str = ""
    store: str | None = None
    head: str | None = None
    label_file: str | None = None
    output: str = ""
    ids: tuple[str, ...] = ()
    project_batch: int = 4096
    dtype: str = "float16"
    encode: EncodeConfig = field(default_factory=EncodeConfig)


@dataclass(frozen=True)
class EmbedConfig:
    """An encoding run."""

    input: str = ""
    output_dir: str = ""
    label_file: str | None = None
    overwrite: bool = False
    encode: EncodeConfig = field(default_factory=EncodeConfig)


@dataclass(frozen=True)
class TrainRunConfig:
    """A training run."""

    store: str = ""
    train: str = ""
    val: str = ""
    test: str = ""
    output_dir: str | None = "."
    #: Where the head goes, if not into ``output_dir``; with neither, nothing is written.
    checkpoint_dir: str | None = None
    fit: TrainConfig = field(default_factory=TrainConfig)


def _value(text: str, like: Any) -> Any:
    if text.lower() in ("null", "none"):
        return None
    if isinstance(like, bool):
        if text.lower() not in ("true", "false"):
            raise ValueError(f"{text} is neither true nor false")
        return text.lower() == "true"
    if isinstance(like, (int, float)):
        return type(like)(text)
    if isinstance(like, tuple):
        return tuple(x for x in text.strip("[]()").split(",") if x)
    return text


def override(config: Any, items: list[str]) -> Any:
    """``config`` with ``key=value`` or ``section.key=value`` items applied; unknown keys are errors."""
    for item in items:
        key, sep, text = item.partition("=")
        if not sep:
            raise ValueError(f"{item} is not key=value")
        first, _, rest = key.partition(".")
        if first not in {f.name for f in dataclasses.fields(config)}:
            raise ValueError(f"unknown setting {key}")
        now = getattr(config, first)
        new = override(now, [f"{rest}={text}"]) if rest else _value(text, now)
        config = dataclasses.replace(config, **{first: new})
    return config
