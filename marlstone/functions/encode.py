"""Texts to vectors by an encoder that every Python worker loads once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def encoded(text: Column | str, load: Callable[[], Encoder]) -> Column:
    """The vector of each text; ``load`` runs once for a task's batches, and the encoder gets a batch at a time. Null stays null."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            known = texts[texts.notna()]
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if len(known):
                out[known.index] = [row.tolist() for row in encoder(known.tolist())]
            yield out

    return encode(text)


def hashed_words(size: int = 64) -> Encoder:
    """An encoder without a model: words fall into ``size`` places with a sign, by their MD5; vectors have length 1."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                out[i, h % size] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode
