"""Typed settings, read once from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

CHARS_PER_TOKEN = 2.5

# Embedding presets (short name -> repository, vector size).
PRESETS = {
    "bge-small-en-v1.5": ("Xenova/bge-small-en-v1.5", 384),
    "bge-base-en-v1.5": ("Xenova/bge-base-en-v1.5", 768),
    "all-MiniLM-L6-v2": ("Xenova/all-MiniLM-L6-v2", 384),
}
DEFAULT_PRESET = "bge-small-en-v1.5"

# Accepted spellings of booleans.
TRUTHY = ("1", "true", "yes", "on")
FALSY = ("0", "false", "no", "off")


@dataclass(frozen=True)
class ChunkerConfig:
    chunk_size: int = 1000
    heading_split_depth: int = 4
    min_chunk_chars: int = 50
    preserve_code_blocks: bool = True
    preserve_latex_blocks: bool = True


@dataclass(frozen=True)
class EngineConfig:
    index_root: str | None = None
    provider: str | None = None
    model: str = DEFAULT_PRESET
    dim: int = 384
    max_chunk_tokens: int | None = None
    index_interval_s: float = 60.0
    chunker: ChunkerConfig = field(default_factory=ChunkerConfig)


def resolve_preset(model: str) -> tuple[str, int | None]:
    """Model identifier and vector size; an unknown name is taken literally."""
    repo, dim = PRESETS.get(model, (model, None))
    return repo, dim


def _number(env: Mapping[str, str], name: str, cast, default, minimum):
    raw = env.get(name, "").strip()
    if not raw:
        return default
    try:
        value = cast(raw)
    except ValueError:
        value = None
    if value is None or value < minimum:
        raise ValueError(f"{name}: expected {cast.__name__} of at least {minimum}, found {raw!r}")
    return value


def parse_bool(name: str, raw: str | None, default: bool) -> bool:
    if raw is None:
        return default
    known = {**dict.fromkeys(TRUTHY, True), **dict.fromkeys(FALSY, False)}
    try:
        return known[raw.strip().lower()]
    except KeyError:
        raise ValueError(f"{name}: {raw!r} is neither of {', '.join(known)}") from None


def load_config(env: Mapping[str, str] | None = None) -> EngineConfig:
    """Settings from ``MARGINALIA_*`` variables; malformed values raise ``ValueError``."""
    env = os.environ if env is None else env
    provider = env.get("MARGINALIA_PROVIDER", "").strip().lower() or None
    if provider not in (None, "hashed", "onnx", "ollama"):
        raise ValueError(f"MARGINALIA_PROVIDER: no provider is called {provider!r}")
    model = env.get("MARGINALIA_MODEL", DEFAULT_PRESET).strip()
    preset_dim = resolve_preset(model)[1] or 384
    tokens = _number(env, "MARGINALIA_MAX_CHUNK_TOKENS", int, None, 1)
    chunker = ChunkerConfig() if tokens is None else ChunkerConfig(chunk_size=int(tokens * CHARS_PER_TOKEN))
    return EngineConfig(
        index_root=env.get("MARGINALIA_INDEX_ROOT"),
        provider=provider,
        model=model,
        dim=_number(env, "MARGINALIA_DIM", int, preset_dim, 1),
        max_chunk_tokens=tokens,
        index_interval_s=_number(env, "MARGINALIA_INDEX_INTERVAL", float, 60.0, 1.0),
        chunker=chunker,
    )
