"""Settings: a JSON file over defaults, section by section."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from quern.operators.context import ContextOptions

#: Tools whose calls say nothing.
SKIP = ["introspect", "todo_list"]


#: Kinds of providers, and the bounds of the job runner's concurrency.
PROVIDERS = ["anthropic", "openai", "ollama", "custom", "offline"]
CONCURRENCY = (5, 10)


@dataclass
class Jobs:
    concurrency: int = 6


@dataclass
class Provider:
    kind: str = "offline"
    model: str = "offline"
    api_key: str = ""
    max_tokens: int = 800
    temperature: float = 0.1


@dataclass
class Settings:
    language: str = "zh"
    skip_tools: list[str] = field(default_factory=lambda: list(SKIP))
    jobs: Jobs = field(default_factory=Jobs)
    provider: Provider = field(default_factory=Provider)
    context: ContextOptions = field(default_factory=ContextOptions)


def resolved(value: str) -> str:
    """``${NAME}`` stands for an environment variable, empty if unset."""
    m = re.fullmatch(r"\$\{(\w+)\}", value)
    return os.environ.get(m[1], "") if m else value


def load(path: str | None = None) -> Settings:
    """Settings of a file; a missing or broken file gives the defaults. Any language but ``en`` is ``zh``."""
    out = Settings()
    try:
        given = json.loads(Path(path).read_text()) if path else {}
    except (OSError, ValueError):
        given = {}
    for section in ("jobs", "provider", "context"):
        target, values = getattr(out, section), given.get(section) or {}
        for f in fields(target):
            if f.name in values:
                v = values[f.name]
                setattr(target, f.name, resolved(v) if isinstance(v, str) else v)
    if "max_observations" in (given.get("context") or {}) and "max_memories" not in given["context"]:
        out.context.max_memories = given["context"]["max_observations"]
    out.skip_tools = given.get("skip_tools", out.skip_tools)
    out.language = "en" if given.get("language") == "en" else "zh"
    return out


def problems(settings: Settings) -> list[str]:
    """What is wrong with settings, in words; empty if nothing is."""
    out = []
    if settings.provider.kind not in PROVIDERS:
        out.append(f"unknown provider: {settings.provider.kind}")
    if not CONCURRENCY[0] <= settings.jobs.concurrency <= CONCURRENCY[1]:
        out.append(f"concurrency {settings.jobs.concurrency} is outside {CONCURRENCY[0]} to {CONCURRENCY[1]}")
    if settings.provider.max_tokens < 1:
        out.append("max_tokens has to be positive")
    return out
