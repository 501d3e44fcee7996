"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits have a word of 64 bits that
differs from each in at most one. So every distinct fingerprint emits its 65
variants within half the radius, variants are shuffled, and fingerprints meet
at a variant. All members of a variant's bucket differ from the variant in one
known bit or in none: a bucket is therefore one 64-bit mask plus one flag, a
fixed-width aggregate that combines before the shuffle, and can hold 65
members at most. Members link to the smallest of their bucket, which keeps the
links of a bucket linear and the components whole; each link is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import small_text_batches, stable, text_of
from cuelight.llm.graph import connected_components

BITS = np.arange(64, dtype=np.uint64)


def simhash(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer.

    Bytes lower-case A-Z and split at 0x20 and 0x09 to 0x0D only, as is asked.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        digest = xxhash.xxh64_intdigest
        last = (ends[shingle - 1 :] - 1).tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), last)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The fingerprint of unsigned hashes: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > len(h)).astype(np.uint64) << BITS).sum(dtype=np.uint64))


def fingerprint_column(text: str, shingle: int = 3):
    @F.pandas_udf("long")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([simhash(t, shingle) for t in batch], np.uint64).view(np.int64))

    return fingerprint(text_of(text))


def linked_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """Distinct ``fp`` (long) to links ``(a, b)`` that keep every component at radius two.

    Two fingerprints with at most two differing bits share a bucket, and each
    bucket links its members to its smallest.
    """
    variants = fingerprints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("bit")).select(
        F.expr("if(bit < 64, fp ^ shiftleft(1L, bit), fp)").alias("variant"),
        F.expr("if(bit < 64, shiftleft(1L, bit), 0L)").alias("mask"),
        (F.col("bit") == 64).alias("own"),
    )
    buckets = (
        variants.groupBy("variant")
        .agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
        .where("bit_count(mask) + cast(own as int) > 1")
    )
    members = F.expr(
        "concat(transform(filter(sequence(0, 63), i -> mask & shiftleft(1L, i) <> 0), i -> variant ^ shiftleft(1L, i)), if(own, array(variant), array()))"
    )
    return (
        buckets.select(members.alias("members"))
        .select(F.array_min("members").alias("b"), F.explode("members").alias("a"))
        .where("a <> b and bit_count(a ^ b) <= 2")
        .distinct()
    )


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Texts of fewer words than ``shingle`` are one shingle; null, empty and blank
    texts have fingerprint zero and link like any other. Equal fingerprints are
    one node of the graph, so a group of copies of any size is one row from the
    first aggregation on. Repeated rows give repeated rows; a null key never
    becomes a component id unless its whole component has null keys. Columns
    other than ``key`` and ``text`` are not read.
    """
    small_text_batches(docs.sparkSession)
    marked = stable(docs.select(F.col(key).alias("doc_id"), fingerprint_column(text, shingle).alias("fp")))
    groups = stable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(linked_fingerprints(groups.select("fp")))
    joined = groups.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = joined.join(least, "component").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, at_least: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that come first, by ``key``, in their component; all columns.

    Components are those of texts whose sets of ``shingle`` words have at least
    this Jaccard similarity. Fingerprints of such texts can differ in many more
    bits than two, and blocks of 64 bits are too short to find those without
    meeting nearly all pairs; so balls of two bits give the first pairs and a prefix of the sets those that
    they lose, and all pass one exact test (:mod:`cuelight.llm.resemblance`). Rows
    that repeat a kept key with another text of the same component stay only once
    per key.
    """
    from cuelight.llm.resemblance import similar_components

    classes = similar_components(docs, key, text, shingle, at_least)
    kept = classes.where("doc_id <=> component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["__kept"]), "left_semi")
