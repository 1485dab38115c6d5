"""Settings from YAML or JSON files: closed keys, typed values, ranges; a key that is unknown or a value out of range is an error."""

from __future__ import annotations

import dataclasses
import json
import typing
from collections.abc import Mapping
from dataclasses import dataclass, field


class SettingsError(ValueError):
    """What is wrong with a settings file; all faults at once."""


def _least(low: float) -> dict:
    return {"least": low}


@dataclass(frozen=True)
class SplitSettings:
    train: float = field(default=0.7, metadata=_least(0.0))
    development: float = field(default=0.15, metadata=_least(0.0))
    test: float = field(default=0.15, metadata=_least(0.0))

    def faults(self) -> list[str]:
        return [] if abs(self.train + self.development + self.test - 1) < 1e-9 else ["fractions do not sum to 1"]


@dataclass(frozen=True)
class NearSettings:
    size: int = field(default=4, metadata=_least(1))
    keys: int = field(default=4, metadata=_least(1))
    max_block: int = field(default=100, metadata=_least(2))
    min_chars: int = field(default=24, metadata=_least(1))
    threshold: float = field(default=0.92, metadata={"least": 0.0, "most": 1.0})


@dataclass(frozen=True)
class RateSettings:
    initial_backoff_seconds: float = field(default=5.0, metadata=_least(0.0))
    max_backoff_seconds: float = field(default=60.0, metadata=_least(0.0))
    request_interval_seconds: float = field(default=0.0, metadata=_least(0.0))
    max_attempts: int = field(default=3, metadata=_least(1))

    def faults(self) -> list[str]:
        return [] if self.initial_backoff_seconds <= self.max_backoff_seconds else ["first backoff above the largest"]


@dataclass(frozen=True)
class SearchSettings:
    ngrams: int = field(default=2, metadata={"least": 1, "most": 3})
    max_features: int = field(default=5000, metadata=_least(1))
    top_k: int = field(default=3, metadata=_least(1))
    min_similarity: float = field(default=0.2, metadata={"least": -1.0, "most": 1.0})


@dataclass(frozen=True)
class SampleSettings:
    training: int = field(default=300, metadata=_least(1))
    development: int = field(default=80, metadata=_least(1))
    random: int = field(default=150, metadata=_least(1))
    challenge: int = field(default=50, metadata=_least(0))
    discovery: int = field(default=200, metadata=_least(1))
    pilot: int = field(default=25, metadata=_least(1))


@dataclass(frozen=True)
class Settings:
    support_author: str
    seed: int = 42
    safe_domains: tuple[str, ...] = ()
    brand_handles: tuple[str, ...] = ()
    split: SplitSettings = SplitSettings()
    near: NearSettings = NearSettings()
    rate: RateSettings = RateSettings()
    search: SearchSettings = SearchSettings()
    samples: SampleSettings = SampleSettings()


def _built(kind: type, value: object, at: str, faults: list[str]) -> object:
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, Mapping):
            faults.append(f"{at or 'settings'}: not a table")
            return None
        hints, given = typing.get_type_hints(kind), {}
        known = {f.name: f for f in dataclasses.fields(kind)}
        faults += [f"{at}{k}: unknown key" for k in sorted(set(value) - set(known))]
        for name, f in known.items():
            if name in value:
                given[name] = _built(hints[name], value[name], f"{at}{name}.", faults)
                low, high = f.metadata.get("least"), f.metadata.get("most")
                if isinstance(given[name], int | float) and ((low is not None and given[name] < low) or (high is not None and given[name] > high)):
                    faults.append(f"{at}{name}: out of range")
            elif f.default is dataclasses.MISSING:
                faults.append(f"{at}{name}: missing")
        if any(x.startswith(at) for x in faults):
            return None
        made = kind(**given)
        faults += [f"{at or 'settings'}: {x}" for x in getattr(made, "faults", list)()]
        return made
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if typing.get_origin(kind) is tuple:
        if isinstance(value, list | tuple) and all(isinstance(x, str) for x in value):
            return tuple(value)
    elif isinstance(value, kind) and not (kind in (int, float) and isinstance(value, bool)):
        return value
    faults.append(f"{at.rstrip('.')}: not a {getattr(kind, '__name__', 'list of texts')}")
    return None


def checked(value: object) -> Settings:
    """Settings from a parsed document; an error that lists every fault."""
    faults: list[str] = []
    made = _built(Settings, value, "", faults)
    if faults or made is None:
        raise SettingsError("; ".join(faults))
    return made  # type: ignore[return-value]


def read_settings(path: str) -> Settings:
    """Settings from a ``.json`` file, or a YAML file where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return checked(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise SettingsError("no YAML reader is installed; use JSON") from e
    return checked(yaml.safe_load(text))
