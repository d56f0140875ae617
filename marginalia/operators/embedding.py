"""Embedding providers: each turns a text column into a vector or the reason there is none."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.config import EngineConfig, resolve_preset

RESULT = "struct<vector:array<float>,reason:string,error:string>"
#: Texts that go to a model or an endpoint at a time.
BATCH = 32


class EmbedderDead(RuntimeError):
    """The provider cannot answer at all; the pass must stop."""


class TooLong(ValueError):
    """The text exceeds what the model reads."""


class Embedder(Protocol):
    identity: str
    dim: int
    #: Tokens that the provider says it takes; None, or no such attribute, if it does not say.
    max_tokens: int | None

    def open(self):
        """Runs once per task and returns ``embed(list of texts) -> list of vectors or exceptions``."""


def _unit(block: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(block, axis=-1, keepdims=True)
    return np.where(norms < 1e-12, 0.0, block / np.maximum(norms, 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class HashedEmbedder:
    """Deterministic stand-in: normal draws seeded by the text's hash."""

    dim: int = 384
    max_chars: int | None = None
    identity: str = "hashed"
    max_tokens: int | None = None

    def open(self):
        def one(text: str):
            if self.max_chars is not None and len(text) > self.max_chars:
                return TooLong(f"{len(text)} characters exceed {self.max_chars}")
            seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
            return _unit(np.random.default_rng(seed).standard_normal(self.dim))

        return lambda texts: [one(t) for t in texts]


@dataclass(frozen=True)
class OnnxEmbedder:
    """A local model folder with ``model.onnx`` and ``tokenizer.json``; masked mean, unit length."""

    folder: str
    dim: int = 384
    max_tokens: int = 512

    @property
    def identity(self) -> str:
        return f"onnx:{self.folder}"

    def open(self):
        try:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(f"{self.folder}/tokenizer.json")
            session = onnxruntime.InferenceSession(f"{self.folder}/model.onnx", providers=["CPUExecutionProvider"])
        except Exception as exc:
            raise EmbedderDead(f"cannot load the model in {self.folder}: {exc}") from exc
        tokenizer.enable_truncation(self.max_tokens)
        tokenizer.enable_padding()
        wanted = {i.name for i in session.get_inputs()}

        def embed(texts: list[str]):
            batch = tokenizer.encode_batch(texts)
            mask = np.array([e.attention_mask for e in batch], dtype=np.int64)
            feed = {
                "input_ids": np.array([e.ids for e in batch], dtype=np.int64),
                "attention_mask": mask,
                "token_type_ids": np.array([e.type_ids for e in batch], dtype=np.int64),
            }
            states = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
            weights = mask[..., None].astype(np.float32)
            mean = (states * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-9)
            return list(_unit(mean))

        return embed


@dataclass(frozen=True)
class OllamaEmbedder:
    """A model behind an HTTP endpoint the user runs; two attempts, back-off on server errors."""

    base_url: str
    model: str
    dim: int = 384
    context: int = 2048
    timeout: float = 30.0

    @property
    def identity(self) -> str:
        return f"ollama:{self.model}"

    @property
    def max_tokens(self) -> int:
        return self.context

    def _post(self, path: str, payload: dict) -> dict:
        request = urllib.request.Request(
            self.base_url.rstrip("/") + path, json.dumps(payload).encode(), {"Content-Type": "application/json"}
        )
        for attempt in (1, 2):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as exc:
                if exc.code < 500 or attempt == 2:
                    raise
                time.sleep(0.2 * attempt)
        raise AssertionError("unreachable")

    def open(self):
        def ask(texts: list[str]) -> list:
            try:
                try:
                    return self._post("/api/embed", {"model": self.model, "input": texts})["embeddings"]
                except urllib.error.HTTPError as exc:
                    if exc.code != 404:
                        raise
                    # An older endpoint takes one text at a time.
                    return [self._post("/api/embeddings", {"model": self.model, "prompt": t})["embedding"] for t in texts]
            except Exception as exc:
                raise EmbedderDead(f"embedding endpoint failed: {exc}") from exc

        def embed(texts: list[str]) -> list:
            out: list = [TooLong(f"text exceeds twice the context of {self.context} tokens") if len(t) // 4 + 1 > 2 * self.context else None for t in texts]
            at = [i for i, known in enumerate(out) if known is None]
            if at:
                for i, vector in zip(at, ask([texts[i] for i in at]), strict=True):
                    out[i] = _unit(np.asarray(vector, dtype=np.float64))
            return out

        return embed


def create_embedder(config: EngineConfig, location: str | None = None) -> Embedder:
    """Provider named by the settings; ``location`` is the model folder or the endpoint. There is none by default."""
    if config.provider == "onnx":
        return OnnxEmbedder(location or resolve_preset(config.model)[0], config.dim)
    if config.provider == "ollama":
        return OllamaEmbedder(location or "http://localhost:11434", config.model, config.dim)
    if config.provider == "hashed":
        return HashedEmbedder(config.dim)
    raise ValueError("no embedding provider is configured: onnx or ollama (hashed gives vectors without meaning, for tests)")


def _outcome(result) -> dict:
    if isinstance(result, TooLong):
        return {"vector": None, "reason": "too-long", "error": str(result)}
    if isinstance(result, Exception):
        return {"vector": None, "reason": "embed-error", "error": str(result)}
    return {"vector": result, "reason": None, "error": None}


def _checked(results: list, dim: int) -> list:
    """A vector of another width than the index holds stops the pass."""
    for r in results:
        if r is not None and not isinstance(r, Exception) and len(r) != dim:
            raise EmbedderDead(f"the provider gave {len(r)} dimensions instead of {dim}")
    return results


def _in_slices(model, values: list[str], dim: int) -> list:
    """Results in the order of ``values``; texts of like length go together, ``BATCH`` at a time."""
    out: list = [None] * len(values)
    order = sorted(range(len(values)), key=lambda i: len(values[i]))
    for start in range(0, len(order), BATCH):
        part = order[start : start + BATCH]
        try:
            results = _checked(model([values[i] for i in part]), dim)
        except EmbedderDead:
            raise
        except Exception:
            # One bad text spoils a batch; try the texts one by one.
            results = []
            for i in part:
                try:
                    results.extend(_checked(model([values[i]]), dim))
                except EmbedderDead:
                    raise
                except Exception as exc:
                    results.append(exc)
        for i, result in zip(part, results, strict=True):
            out[i] = result
    return out


def embed(texts: Column, embedder: Embedder) -> Column:
    """Vector, or reason and error; all null for a null text. A dead provider fails the job, so no half pass is published."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = embedder.open()
        for batch in batches:
            values = batch.tolist()
            asked = [i for i, v in enumerate(values) if isinstance(v, str)]
            out = [{"vector": None, "reason": None, "error": None}] * len(values)
            for i, result in zip(asked, _in_slices(model, [values[i] for i in asked], embedder.dim), strict=True):
                out[i] = _outcome(result)
            yield pd.DataFrame(out, columns=["vector", "reason", "error"])

    return run(texts)


def embed_query(embedder: Embedder, text: str) -> list[float]:
    """The vector of one query, computed where it is asked for."""
    result = embedder.open()([text])[0]
    if isinstance(result, Exception):
        raise result
    return [float(x) for x in result]
