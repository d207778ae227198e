"""A pluggable embedder as an Arrow UDF. The default is a stand-in, not a language model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embed = Callable[[list[str]], np.ndarray]


class HashingEmbedder:
    """Signed hashing of lower-case words into ``dim`` places, L2-normalised."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, (h >> 1) % self.dim] += 1 if h & 1 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).astype(np.float32)


def embed_texts(texts: list[str], model: Callable[[], Embed] = HashingEmbedder) -> list[list[float]]:
    """Vectors of a list of texts; any blank text raises ValueError."""
    if any(not (t or "").strip() for t in texts):
        raise ValueError("a text to embed is blank")
    return model()(texts).tolist() if texts else []


def embed_column(text: Column, model: Callable[[], Embed] = HashingEmbedder) -> Column:
    """array<float> of each text; the model is made once a task. Null and blank: null."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = model()
        for batch in batches:
            good = [i for i, t in enumerate(batch) if t is not None and t.strip()]
            vectors = embed([batch.iloc[i] for i in good]) if good else []
            out: list = [None] * len(batch)
            for i, v in zip(good, vectors, strict=True):
                out[i] = np.asarray(v, np.float32)
            yield pd.Series(out)

    return run(text)
