"""Settings in TOML, with the engine's defaults."""

from __future__ import annotations

import re
import tomllib
from dataclasses import asdict, dataclass
from pathlib import Path

from lectern.operators.feeds import Policy

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "": 1}


def seconds(text: str) -> int:
    """Seconds of 30s, 5m, 6h, 2d or a plain number."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([smhd]?)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


@dataclass
class Config:
    default_interval_secs: int = 900
    backoff_base_secs: int = 60
    backoff_cap_secs: int = 3600
    disable_after_failures: int = 10
    enrichment_max_chars: int = 60_000

    def policy(self) -> Policy:
        return Policy(self.default_interval_secs, self.backoff_base_secs, self.backoff_cap_secs, self.disable_after_failures)


def load(path: str | Path) -> Config:
    """Settings of a file; a missing one is written with the defaults."""
    path = Path(path)
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(f"{k} = {v}\n" for k, v in asdict(Config()).items()))
    found = tomllib.loads(path.read_text())
    return Config(**{k: seconds(v) if isinstance(v, str) else v for k, v in found.items() if k in asdict(Config())})
