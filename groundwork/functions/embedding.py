"""Text to vector in Arrow batches, with any embedder the caller supplies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str]], np.ndarray]

_TERM = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1 << 16)
def _number(term: str) -> int:
    """A stable number for a term; the cache is bounded however large the vocabulary is, to about 10 MB a worker."""
    return int.from_bytes(md5(term.encode()).digest()[:3], "big")


def hashed_terms(dims: int = 64) -> Embedder:
    """Signed hashed bag of terms with unit length: the default embedder, no model needed."""

    def embed_texts(texts: Sequence[str]) -> np.ndarray:
        sums = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            # first `dims` slots count up, the next `dims` count down
            slots = [_number(term) % (2 * dims) for term in _TERM.findall((text or "").lower())]
            counts = np.bincount(np.array(slots, dtype=np.int64), minlength=2 * dims)
            sums[row] = counts[:dims] - counts[dims:]
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return sums / np.where(length == 0, 1.0, length)

    return embed_texts


def embed(df: DataFrame, text: str, embedder: Embedder, dims: int, batch: int = 64,
          into: str = "embedding") -> DataFrame:
    """Add `into`, an array<float>, from the column `text`; `batch` texts for each call, and no more are Python strings
    at once."""

    @F.arrow_udf("array<float>")
    def vectors(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [np.asarray(embedder(column.slice(i, batch).to_pylist()), dtype=np.float32)
                     for i in range(0, len(column), batch)]
            flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0, np.float32)
            ends = np.arange(0, len(flat) + 1, dims, dtype=np.int32)
            yield pa.ListArray.from_arrays(ends, pa.array(flat))

    return df.withColumn(into, vectors(F.col(text)))
