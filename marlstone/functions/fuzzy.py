"""Fuzzy string scorers as Arrow-batched functions.

Jaro-Winkler and the Indel ratio follow their published definitions. The
weighted ratio takes the largest of the whole, sorted-token, token-set and, for
lengths far apart, best-window variants, each scaled down by how loose it is.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=100_000)
def jaro_winkler(a: str, b: str, prefix: float = 0.1) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    score = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    shared = 0
    while shared < min(4, len(a), len(b)) and a[shared] == b[shared]:
        shared += 1
    return score + shared * prefix * (1 - score) if score > 0.7 else score


@lru_cache(maxsize=100_000)
def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / both lengths, from 0 to 1; bit-parallel over the shorter string's characters."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & where.get(c, 0)
        row = ((row + match) | (row - match)) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def _best_window(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    return max(indel_ratio(short, long[max(0, i) : i + n]) for i in range(-n + 1, len(long)))


def _sorted_tokens(a: str, b: str, score) -> float:
    return score(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str, score=indel_ratio) -> float:
    x, y = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = score(first, second)
    return max(best, score(both, first), score(both, second)) if both else best


@lru_cache(maxsize=100_000)
def weighted_ratio(a: str, b: str) -> float:
    """From 0 to 1."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    whole = indel_ratio(a, b)
    if apart < 1.5:
        return max(whole, 0.95 * _sorted_tokens(a, b, indel_ratio), 0.95 * token_set_ratio(a, b))
    scale = 0.9 if apart < 8 else 0.6
    return max(whole, scale * _best_window(a, b), 0.95 * scale * max(_sorted_tokens(a, b, _best_window), token_set_ratio(a, b, _best_window)))


SCORERS = {"jaro_winkler": jaro_winkler, "indel": indel_ratio, "token_set": token_set_ratio, "weighted": weighted_ratio}


def similarity(left: Column, right: Column, scorer: str = "weighted") -> Column:
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        one = SCORERS[scorer]
        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return F.pandas_udf(score, "double")(left, right)
