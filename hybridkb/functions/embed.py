"""Embedders: the hashing embedder and the seam for others."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

import regex

DIM, NGRAM = 256, 3
SEED = 20240601
_RUN = regex.compile(r"[\p{Alphabetic}\p{N}]+")
_M = (1 << 64) - 1


class HashEmbedder:
    """Signed feature hashing of tokens and their character n-grams, to unit length.

    A token of at most ``ngram`` characters is its own n-gram and counts twice. An empty text gives
    zeros. The features of a token are hashed once for each worker and kept up to ``cache`` tokens.
    """

    def __init__(self, dim: int = DIM, ngram: int = NGRAM, seed: int = SEED, cache: int = 200_000):
        self.dim, self.ngram, self.seed, self.cache = dim, ngram, seed, cache
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    @property
    def embedder_id(self) -> int:
        turned = ((self.seed << 8) | (self.seed >> 56)) & _M
        return derive_id("hash", self.dim, self.ngram ^ turned)

    def _features(self, token: str) -> tuple[np.ndarray, np.ndarray]:
        got = self._known.get(token)
        if got is None:
            n = self.ngram
            grams = [token] if len(token) <= n else [token[i : i + n] for i in range(len(token) - n + 1)]
            h = np.array([xxhash.xxh3_64_intdigest(f.encode(), self.seed) for f in (token, *grams)], np.uint64)
            got = (h % np.uint64(self.dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
            if len(self._known) >= self.cache:
                self._known.clear()
            self._known[token] = got
        return got

    def embed(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.dim)
        parts = [self._features(t) for t in _RUN.findall((text or "").lower())]
        if parts:
            out += np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), self.dim)
        size = np.sqrt((out * out).sum())
        return (out / size if size > 0 else out).astype(np.float32)

    def embed_batch(self, texts) -> list[np.ndarray]:
        return [self.embed(t if isinstance(t, str) else None) for t in texts]


def derive_id(name: str, dim: int, params: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(name.encode()) ^ (dim * 11400714819323198485 & _M) ^ (params * 14029467366897019727 & _M)


def embed_udf(embedder=None) -> Callable[[Column], Column]:
    """A column function over any object with ``embed_batch(texts)`` and ``dim``; vectors of another length are an error."""
    used = embedder or HashEmbedder()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        got = used.embed_batch(list(texts))
        if len(got) != len(texts) or any(len(v) != used.dim for v in got):
            raise ValueError(f"the embedder must give {len(texts)} vectors of length {used.dim}")
        return pd.Series(list(got), dtype=object)

    return run


class OnnxEmbedder:
    """A sentence encoder from a local ONNX model and tokenizer file; mean over tokens, unit length.

    Needs onnxruntime, tokenizers and model files, which this package doesn't bring."""

    def __init__(self, model: str, tokenizer: str, dim: int = 384, batch: int = 256, max_tokens: int = 512):
        self.model, self.tokenizer, self.dim, self.batch, self.max_tokens = model, tokenizer, dim, batch, max_tokens
        self._loaded = None

    def __getstate__(self):
        return {**self.__dict__, "_loaded": None}

    def _load(self):
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(self.tokenizer)
            t.enable_padding()
            t.enable_truncation(self.max_tokens)
            self._loaded = onnxruntime.InferenceSession(self.model), t
        return self._loaded

    def embed_batch(self, texts) -> list[np.ndarray]:
        session, tokenizer = self._load()
        names = {i.name for i in session.get_inputs()}
        out: list[np.ndarray] = []
        for k in range(0, len(texts), self.batch):
            enc = tokenizer.encode_batch([t or "" for t in texts[k : k + self.batch]])
            mask = np.array([e.attention_mask for e in enc], np.int64)
            feed = {"input_ids": np.array([e.ids for e in enc], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            hidden = session.run(None, {n: v for n, v in feed.items() if n in names})[0]
            v = (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            out.extend((v / np.where(size > 0, size, 1)).astype(np.float32))
        return out

    def embed(self, text: str | None) -> np.ndarray:
        return self.embed_batch([text or ""])[0]
