"""Embedding providers: a text to a vector of length one, or none."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose vectors a worker keeps, besides those of the texts at hand.
MOST_KNOWN, TEXTS_AT_ONCE = 100_000, 100


class EmbeddingProvider(Protocol):
    """``revision`` names what the vectors depend on; vectors of different revisions aren't compared."""

    revision: str
    dimension: int

    def vector(self, text: str) -> list[float] | None: ...


class HashingEmbedder:
    """The mean of fixed pseudo-random vectors of a text's words, divided by its length; none for a text without words.

    Deterministic and without a model: for tests, and where nothing better is at hand.
    """

    def __init__(self, dimension: int = 64):
        self.dimension, self.revision = dimension, f"hashing-2-{dimension}"
        self._number: dict[str, int] = {}  # rows of known words' vectors
        self._known = np.empty((0, dimension))

    def _of_words(self, words: list[str]) -> np.ndarray:
        """Numbers in [-1, 1): the 64-bit states that start at a word's hash, a step apart, mixed."""
        seeds = np.frombuffer(b"".join(hashlib.sha256(w.encode()).digest()[:8] for w in words), "<u8")
        # The step and the multipliers of SplitMix64.
        x = seeds[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, self.dimension + 1, dtype=np.uint64)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-52 - 1

    def _learn(self, words: set[str]) -> None:
        if len(self._number) > MOST_KNOWN:
            self._number, self._known = {}, np.empty((0, self.dimension))
        new = sorted(w for w in words if w not in self._number)
        if new:
            at, end = len(self._number), len(self._number) + len(new)
            if end > len(self._known):
                self._known = np.concatenate([self._known[:at], np.empty((end, self.dimension))])
            self._known[at:end] = self._of_words(new)
            self._number.update(zip(new, range(at, end), strict=True))

    def vectors(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The texts' vectors; words that aren't known are made together, and each text's are summed at once."""
        each = [t.lower().split() if t else [] for t in texts]
        self._learn(set().union(*each))
        out: list[np.ndarray | None] = []
        for words in each:
            mean = self._known[[self._number[w] for w in words]].sum(axis=0) / max(1, len(words))
            length = np.linalg.norm(mean)
            out.append(mean / length if length > 0 else None)
        return out

    def vector(self, text: str) -> list[float] | None:
        v = self.vectors([text])[0]
        return None if v is None else v.tolist()


def embedded(text: Column, provider: EmbeddingProvider) -> Column:
    """Vectors in Arrow batches; null where the provider has none or one of another dimension. A provider may offer
    ``vectors``, which takes several texts."""
    several = getattr(provider, "vectors", lambda texts: [None if t is None else provider.vector(t) for t in texts])

    @F.arrow_udf("array<float>")
    def of(texts: pa.Array) -> pa.Array:
        parts = []
        for lo in range(0, len(texts), TEXTS_AT_ONCE):
            own = several(texts.slice(lo, TEXTS_AT_ONCE).to_pylist())
            parts.append(pa.array([np.asarray(v, np.float32) if v is not None and len(v) == provider.dimension else None for v in own], pa.list_(pa.float32())))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return of(text)
