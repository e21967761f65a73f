"""Settings of a crawl, in one place."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class CrawlConfig:
    strict: bool = False
    repair: bool = False
    dedupe: bool = False
    strip_draft_cookies: bool = True
    streaming: bool = False
    stream_keys: tuple[str, ...] = ()
    stream_max_bytes: int = 10_000_000
    stream_check_interval: int = 8_192
    stream_encoding: str = "utf-8"
    rsc_url_pattern: str | None = None
    retry_min_confidence: float = 0.5
    retry_max_times: int = 2
    dedupe_across_pages: bool = False
    dedupe_keys: tuple[str, ...] = ()
    throttle_window: int = 20
    throttle_min_confidence: float = 0.7
    throttle_factor: float = 2.0
    drift_min_samples: int = 5
    drift_threshold: float = 0.3
    pipeline_keys: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.strict and self.repair:
            raise ValueError("strict and repair exclude each other")
        if self.throttle_window < 1 or self.throttle_factor <= 0:
            raise ValueError("a throttle needs a window of one at least and a positive factor")

    @classmethod
    def of(cls, options: dict) -> CrawlConfig:
        """From a mapping of names in any case; others are refused."""
        known = {f.name: f for f in fields(cls)}
        if {"dedupe_key", "dedupe_keys"} <= {k.lower() for k in options}:
            raise ValueError("dedupe_key and dedupe_keys exclude each other")
        options = {"dedupe_keys" if k.lower() == "dedupe_key" else k: [v] if k.lower() == "dedupe_key" and isinstance(v, str) else v for k, v in options.items()}
        given = {k.lower(): tuple(v) if isinstance(v, (list, set)) else v for k, v in options.items()}
        if unknown := given.keys() - known.keys():
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)

    @property
    def parsing(self) -> dict[str, bool]:
        """What the operators on pages take: ``tables.chunks(df, **config.parsing)``."""
        return {"strict": self.strict, "repair": self.repair}

    @classmethod
    def recommended(cls, **changes) -> CrawlConfig:
        """What suits most crawls: repair, and one copy of each item."""
        return replace(cls(repair=True, dedupe=True, dedupe_across_pages=True), **changes)
