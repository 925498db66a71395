"""Text functions: built-in expressions where they suffice, Arrow-batched ones where they don't."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"


def without_accents(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


#: Texts that are Python strings at once, if they are short; of long ones fewer are.
RUN, RUN_BYTES = 256, 1 << 20


def _plain(texts: pa.Array) -> pa.Array:
    step = max(1, min(RUN, RUN_BYTES * len(texts) // max(texts.nbytes, 1)))
    parts = [pa.array([t if t is None else without_accents(t) for t in texts.slice(at, step).to_pylist()], pa.string()) for at in range(0, len(texts), step)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def strip_accents(text: Column | str) -> Column:
    """Canonical decomposition without combining marks; no built-in does this."""
    return F.arrow_udf(_plain, "string")(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def chunks(words: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that overlap; no words, no window."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.slice(words, i + 1, size))).otherwise(F.array().cast("array<array<string>>"))
