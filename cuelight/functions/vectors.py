"""Vector expressions; all sums in double."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words whose features a worker keeps, and the longest of them.
WORDS_KEPT, LONG_WORD = 200_000, 40


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, between 0 and 2; 1 if a vector is zero, null if one is null. Rounding never takes it under 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    distance = 1 - F.when(norm == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norm))
    return F.when(distance < 0, F.lit(0.0)).otherwise(distance)


def score(distance: Column) -> Column:
    """Distance as a score between 0 and 1."""
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """Unit vectors by signed feature hashing of words and their trigrams, on Arrow batches.

    A stand-in for a language model's encoder, with the same shape: deterministic,
    alike for texts that share words, zero for texts without any.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for texts in batches:
            out = np.zeros((len(texts), dim))
            for row, t in zip(out, texts):
                found = Counter(re.findall(r"\w+", (t or "").lower()))
                if not found:
                    continue
                parts = []
                for w in found:
                    p = known.get(w)
                    if p is None:
                        if len(known) > WORDS_KEPT:
                            known.clear()
                        p = word_features(w, dim)
                        if len(w) <= LONG_WORD:
                            known[w] = p
                    parts.append(p)
                times = np.repeat(np.fromiter(found.values(), float, len(found)), [len(p[0]) for p in parts])
                row += np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) * times, dim)
            norms = np.linalg.norm(out, axis=1)
            yield pd.Series(list((out / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)))

    return embed(text)


def word_features(word: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of a word and of its trigrams."""
    marked = f"<{word}>"
    hashes = [zlib.crc32(g.encode("utf-8")) for g in (marked, *(marked[k : k + 3] for k in range(len(marked) - 2)))]
    return np.array([h % dim for h in hashes]), np.array([1.0 if h >> 31 else -1.0 for h in hashes])
