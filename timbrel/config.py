"""Settings: a TOML file with strict keys, or defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

PLACES = ("~/.config/timbrel/config.toml", "/etc/timbrel/config.toml")


class ConfigError(ValueError):
    """A settings file with unknown keys or values out of range."""


@dataclass(frozen=True)
class Analysis:
    window_size_minutes: int = 5
    burst_multiplier: float = 3.0
    auth_failure_threshold: int = 10
    correlation_gap_seconds: int = 120
    spike_factor: float = 3.0


@dataclass(frozen=True)
class Inference:
    threshold: float = 0.35
    enabled: bool = True


@dataclass(frozen=True)
class State:
    path: str = "~/.local/share/timbrel/state"
    baseline_alpha: float = 0.2


@dataclass(frozen=True)
class Security:
    allowed_log_paths: tuple[str, ...] = ()
    max_file_size_mb: int = 2048


@dataclass(frozen=True)
class Output:
    color: bool = True
    show_remediation: bool = True


@dataclass(frozen=True)
class Config:
    analysis: Analysis = field(default_factory=Analysis)
    inference: Inference = field(default_factory=Inference)
    state: State = field(default_factory=State)
    security: Security = field(default_factory=Security)
    output: Output = field(default_factory=Output)


#: Least values; True: the least value itself is not allowed.
_LEAST = {"window_size_minutes": (1, False), "burst_multiplier": (0, True), "auth_failure_threshold": (1, False), "correlation_gap_seconds": (0, False), "spike_factor": (0, True), "threshold": (0, False), "baseline_alpha": (0, True), "max_file_size_mb": (1, False)}
_MOST = {"threshold": 1, "baseline_alpha": 1}


def load(path: str | None = None) -> Config:
    """Settings of the given file, else of the first usual place that has one, else defaults."""
    found = [Path(path).expanduser()] if path else [p for p in (Path(x).expanduser() for x in PLACES) if p.exists()]
    if not found:
        return Config()
    try:
        data = tomllib.loads(found[0].read_text())
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{found[0]}: {e}") from e
    kinds = {"analysis": Analysis, "inference": Inference, "state": State, "security": Security, "output": Output}
    parts = {}
    for name, values in data.items():
        known = {f.name: f for f in fields(kinds[name])} if name in kinds else {}
        if name not in kinds or not isinstance(values, dict) or set(values) - set(known):
            raise ConfigError(f"{found[0]}: unknown setting in {name}")
        for key, value in values.items():
            kind = type(known[key].default)
            fits = isinstance(value, list) and all(isinstance(v, str) for v in value) if kind is tuple else type(value) is kind or (kind is float and type(value) is int)
            if not fits:
                raise ConfigError(f"{found[0]}: {name}.{key} is no {'list of texts' if kind is tuple else kind.__name__}")
            low, strict = _LEAST.get(key, (None, False))
            if isinstance(value, (int, float)) and low is not None and (value < low or strict and value == low or value > _MOST.get(key, value)):
                raise ConfigError(f"{found[0]}: {name}.{key} is out of range")
        parts[name] = kinds[name](**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
    return Config(**parts)
