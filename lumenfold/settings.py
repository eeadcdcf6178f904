"""Settings in one place: defaults, then a file of NAME=value lines, then the environment, which wins."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_words: int = 400
    chunk_overlap: int = 1
    day_first: bool = False
    pool: int = 40
    k: int = 8
    trend_gate: int = 30
    mtime_warning: float = 0.3
    quiet: float = 1.0

    @classmethod
    def read(cls, environment: Mapping[str, str], lines: str = "", prefix: str = "LUMENFOLD_") -> Settings:
        """Names are upper-case with ``prefix``. Blank lines and those that begin with # say nothing; quotes around a value go; unknown names are left alone."""
        given = {}
        for line in lines.splitlines():
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not name.startswith("#"):
                given[name.strip()] = value.strip().strip("'\"")
        given |= environment
        own = {f.name: given[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in given}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: v.lower() in ("1", "true", "yes") if kinds[k] is bool else kinds[k](v) for k, v in own.items()})
