"""Embedders that are passed in, adapters for them, and three deterministic ones for tests and queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def adapt(model) -> Callable[[list[str]], list]:
    """A function of a list of texts, from an object with ``embed_batch`` or ``encode``, or a callable."""
    if model is None:
        raise ValueError("an embedder is needed")
    for name in ("embed_batch", "encode"):
        if callable(getattr(model, name, None)):
            return getattr(model, name)
    if callable(model):
        return model
    raise TypeError("an embedder needs embed_batch or encode, or is callable")


def adapt_tokens(model) -> tuple[Callable, Callable]:
    """(text to token vectors, text to a vector), from a pair of callables or an object with embed_as_tokens and embed."""
    if model is None:
        raise ValueError("an embedder is needed")
    if isinstance(model, tuple) and len(model) == 2 and all(map(callable, model)):
        return model
    if callable(getattr(model, "embed_as_tokens", None)) and callable(getattr(model, "embed", None)):
        return model.embed_as_tokens, model.embed
    raise TypeError("a token embedder needs embed_as_tokens and embed, or is a pair of callables")


class _Batched:
    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [self.embed(t) for t in texts]


class HashEmbedder(_Batched):
    """Counts of hashed byte trigrams, of unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: str) -> np.ndarray:
        b = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
        v = np.zeros(self.dim, np.float32)
        if len(b) >= 3:
            np.add.at(v, ((b[:-2] * 31 + b[1:-1]) * 31 + b[2:]) % self.dim, 1)
        norm = np.sqrt((v * v).sum())
        if norm == 0:
            v[0] = norm = 1
        return v / norm


class TopicEmbedder(_Batched):
    """Occurrences of each keyword, any case, and a small constant."""

    def __init__(self, keywords: list[str]):
        self.keywords = [k.lower() for k in keywords]

    def embed(self, text: str) -> np.ndarray:
        low = text.lower()
        return np.array([*(float(low.count(k)) for k in self.keywords), 0.05], np.float32)


class CharTokenEmbedder:
    """A vector for each code point, by its number and place."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def embed_as_tokens(self, text: str) -> np.ndarray:
        v = np.zeros((len(text), self.dim), np.float32)
        v[:, 0] = [ord(c) % 97 for c in text]
        if self.dim > 1:
            v[:, 1] = np.arange(len(text)) % 13
        return v

    def embed(self, text: str) -> np.ndarray:
        v = self.embed_as_tokens(text)
        return v.mean(axis=0, dtype=np.float32) if len(v) else np.zeros(self.dim, np.float32)
