"""Settings from environment-like mappings, with defaults; argument checks."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

TRUE = {"1", "true", "yes", "on"}
EVENT_TYPES = ("play", "pause", "skip", "complete")


def flag(name: str, default: bool, env: Mapping[str, str] | None = None) -> bool:
    raw = (os.environ if env is None else env).get(name)
    return default if raw is None or not raw.strip() else raw.strip().lower() in TRUE


def listed(name: str, default: list[str], env: Mapping[str, str] | None = None) -> list[str]:
    raw = (os.environ if env is None else env).get(name) or ""
    return [x for x in map(str.strip, raw.split(",")) if x] or list(default)


def first(*names: str, default: str = "", env: Mapping[str, str] | None = None) -> str:
    source = os.environ if env is None else env
    return next((source[n].strip() for n in names if source.get(n, "").strip()), default)


@dataclass(frozen=True)
class Settings:
    topics: list[str] = field(default_factory=lambda: ["language models", "retrieval augmented generation", "robotics"])
    episodes: int = 3
    window_days: int = 7
    timezone: str = "UTC"
    embedder: str = "auto"
    tts: str = "auto"
    keys: Mapping[str, str] = field(default_factory=dict)

    def has(self, provider: str) -> bool:
        return bool(self.keys.get(provider))


def settings(env: Mapping[str, str] | None = None) -> Settings:
    env = os.environ if env is None else env
    base = Settings()
    return Settings(
        topics=listed("LECTERN_TOPICS", base.topics, env),
        episodes=int(first("LECTERN_EPISODES", default=str(base.episodes), env=env)),
        window_days=int(first("LECTERN_WINDOW", default=str(base.window_days), env=env)),
        embedder=first("LECTERN_EMBEDDER", default="auto", env=env).lower(),
        tts=first("LECTERN_TTS", default="auto", env=env).lower(),
        keys={p: first(f"{p.upper()}_API_KEY", env=env) for p in ("openai", "anthropic", "elevenlabs")},
    )


def check_question(text: str) -> str:
    if not 3 <= len(text) <= 500:
        raise ValueError("a question has 3 to 500 characters")
    return text


def check_event(kind: str) -> str:
    if kind not in EVENT_TYPES:
        raise ValueError(f"unknown event type {kind!r}")
    return kind


def check_range(value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{value} is not in {low}..{high}")
    return value
