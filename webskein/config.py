"""Settings of a crawl: defaults, a JSON file, and overrides. What is given explicitly wins over the file, the file over defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Crawl:
    max_depth: int = 5
    max_urls: int | None = None
    follow_external: bool = False
    respect_robots: bool = True
    render_mode: str = "auto"


@dataclass(frozen=True)
class Politeness:
    requests_per_second: float = 2.0
    min_delay: float = 0.5
    max_delay: float = 3.0
    adaptive: bool = True


@dataclass(frozen=True)
class Extraction:
    store_html: bool = False
    strict_media: bool = True
    least_similarity: float = 0.85


@dataclass(frozen=True)
class Output:
    folder: str = "output"
    batch_size: int = 100


@dataclass(frozen=True)
class Config:
    crawl: Crawl = field(default_factory=Crawl)
    politeness: Politeness = field(default_factory=Politeness)
    extraction: Extraction = field(default_factory=Extraction)
    output: Output = field(default_factory=Output)

    def __post_init__(self) -> None:
        if self.crawl.render_mode not in ("auto", "static", "javascript"):
            raise ValueError("render_mode is auto, static or javascript")
        if not 0 < self.politeness.min_delay <= self.politeness.max_delay:
            raise ValueError("min_delay is positive and at most max_delay")

    def with_values(self, given: dict[str, dict[str, Any]]) -> "Config":
        """The settings with these parts' values instead; unknown names are refused."""
        parts = {f.name: getattr(self, f.name) for f in fields(self)}
        if unknown := set(given) - set(parts):
            raise ValueError(f"no such settings: {sorted(unknown)}")
        return Config(**{n: replace(p, **given.get(n, {})) for n, p in parts.items()})

    def as_dict(self) -> dict[str, dict[str, Any]]:
        return asdict(self)


def load(path: str | None = None, overrides: dict[str, dict[str, Any]] | None = None) -> Config:
    config = Config()
    if path:
        with open(path, encoding="utf-8") as f:
            config = config.with_values(json.load(f))
    return config.with_values(overrides or {})
