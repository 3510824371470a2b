"""Knobs of the dubbing plan; every one may be given by keyword, environment (CUEGRID_<NAME>) or default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    source_lang: str = "en"
    target_lang: str = "de"
    #: Speech rate that fits a slot, and how far a clip may be sped up or slowed down.
    chars_per_second: float = 15.0
    max_speedup: float = 1.4
    max_slowdown: float = 0.85
    min_budget: int = 20
    #: Segmentation caps: characters, seconds, and the pause that ends a phrase.
    max_chars: int = 140
    max_duration: float = 8.0
    max_gap: float = 0.6
    #: Milliseconds of reference audio per voice.
    reference_ms: int = 20_000
    #: Fragments below this many characters are merged.
    min_fragment_chars: int = 3
    #: Earlier lines shown to a translator.
    context_lines: int = 6
    #: Average-linkage clusters below this similarity stay apart.
    speaker_similarity: float = 0.75
    device: str = "cpu"
    compute_type: str = ""

    @classmethod
    def resolve(cls, env_file: str | None = ".env", **given) -> Settings:
        """Keyword arguments outrank the environment, which outranks ``env_file`` (NAME=value lines), which
        outranks the defaults."""
        values, filed = {}, read_env(env_file)
        for f in fields(cls):
            name = f"CUEGRID_{f.name.upper()}"
            raw = os.environ.get(name, filed.get(name))
            if given.get(f.name) is not None:
                values[f.name] = given[f.name]
            elif raw is not None:
                values[f.name] = type(f.default)(raw)
        return cls(**values)

    @property
    def resolved_device(self) -> str:
        """The device asked for; ``auto`` takes the best there is."""
        return detect_device() if self.device == "auto" else self.device

    @property
    def resolved_compute_type(self) -> str:
        return self.compute_type or ("float16" if self.resolved_device == "cuda" else "int8")


def read_env(path: str | None) -> dict[str, str]:
    """NAME=value lines; blank and # lines are passed over, quotes around a value dropped."""
    if not path or not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {name.strip().removeprefix("export ").strip(): value.strip().strip("\"'") for name, value in pairs}


def detect_device() -> str:
    """cuda before mps before cpu; cpu where there is no tensor library to ask."""
    try:
        import torch
    except ImportError:
        return "cpu"
    if torch.cuda.is_available():
        return "cuda"
    mps = getattr(torch.backends, "mps", None)
    return "mps" if mps is not None and mps.is_available() else "cpu"
