"""Substring dedup by relative Lempel-Ziv parsing over an index of all documents.

A passage of 35 words that occurs twice is found without comparing documents.
The hashes of 12 words inside it have a least one, its anchor, which depends on the passage
alone. So the windows of a document fall into runs with one anchor, and the
words of a run, 35 to 58, are a reference block. The index has every block of
the corpus under its anchor. A document is factored greedily: while its next
block is in the index a second time, the factor goes on, and all words of the
blocks are in it. A factor ends where a block occurs once only. There, and only
there, single windows are looked up: those of all different blocks under the
same anchor, which are the only ones that can hold the same 35 words. Factors
and such windows are the duplicate spans; nothing shorter than a window is one.

A document needs not meet blocks whose anchor it hasn't: they can't have a
window of it. Blocks are counted before they are shuffled whole, so a passage of many copies
is one row from each task, and no row holds more than a document. Texts are
shuffled only where windows are asked of them or spans are found in them, and a
few others that a bitmap takes for such.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import small_text_batches, stable, text_of

WINDOW, ANCHOR = 35, 12
#: Odd multipliers of the hashes of anchors and of blocks and windows, modulo 2 ** 64 (any others would do).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Rows of a batch that a task returns.
ROWS = 50_000
#: A run of windows is one number: its first window times this, and how many there are.
RUN = 1 << 16
BLOCK = "key_a long, key_b long, run long, mark long, whole long"
#: A block with the hashes of its windows in order: written so, a window takes 8 bytes.
OPENED = "key_a long, key_b long, run long, mark long, wholes array<long>"
#: Bits of the map of keys that is sent to every task: 8 MB at any size of the table.
BITS = 1 << 26


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** k`` modulo 2 ** 64 for k under n."""
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Hashes:
    """Hashes of runs of words: a sum of word hashes by powers of a base, mixed, from running sums."""

    def __init__(self) -> None:
        self.n = 0
        self.power: list[np.ndarray] = []
        self.inverse: list[np.ndarray] = []

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(2 * self.n, n, 1 << 12)
            self.power = [_powers(b, self.n) for b in BASES]
            self.inverse = [_powers(pow(b, -1, 1 << 64), self.n) for b in BASES]

    def sums(self, words: list[bytes]) -> list[np.ndarray]:
        n = len(words)
        self.grow(n + 1)
        w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        out = []
        with np.errstate(over="ignore"):
            for power in self.power:
                s = np.zeros(n + 1, np.uint64)
                np.cumsum(w * power[:n], out=s[1:])
                out.append(s)
        return out

    def of(self, sums: list[np.ndarray], base: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """Hashes of the runs at ``starts``; the length counts in."""
        s = sums[base]
        with np.errstate(over="ignore"):
            h = (s[starts + lengths] - s[starts]) * self.inverse[base][starts]
            h ^= np.asarray(lengths, np.uint64) * np.uint64(BASES[1 - base])
            h = (h ^ (h >> np.uint64(31))) * np.uint64(BASES[1])
            return h ^ (h >> np.uint64(29))


def blocks_of(sums: list[np.ndarray], hashes: Hashes, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor hash and anchor place of each run of windows with one anchor."""
    n = len(sums[0]) - 1
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none
    h = hashes.of(sums, 0, np.arange(n - anchor + 1), anchor)
    span = window - anchor + 1

    def leftmost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[b] < h[a], b, a)

    at, width = np.arange(len(h)), 1
    while 2 * width <= span:
        at, width = leftmost(at[: len(at) - width], at[width:]), 2 * width
    if width < span:
        at = leftmost(at[: len(at) - (span - width)], at[span - width :])
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return first, np.diff(np.append(first, len(at))), h[at[first]], at[first]


def _blocks(window: int, anchor: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            parts, held = [], 0
            for a, b, body in zip(batch["key_a"], batch["key_b"], batch["body"]):
                words = body.split()
                if len(words) < window:
                    continue
                sums = hashes.sums(words)
                first, many, mark, _ = blocks_of(sums, hashes, window, anchor)
                whole = hashes.of(sums, 1, first, many + window - 1)
                parts.append((np.full(len(first), a), np.full(len(first), b), first * RUN + many, mark.view(np.int64), whole.view(np.int64)))
                held += len(first)
                if held >= ROWS:
                    yield _frame(parts)
                    parts, held = [], 0
            if parts:
                yield _frame(parts)

    return rows


def _frame(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([p[k] for p in parts]) for k, c in enumerate(["key_a", "key_b", "run", "mark", "whole"])})


def _windows(window: int):
    """The asked blocks of each text, with the hashes of their windows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, unpack = Hashes(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            parts, held = [], 0
            for a, b, packed, asked in zip(batch["key_a"], batch["key_b"], batch["packed"], batch["asked"]):
                sums = hashes.sums(unpack(packed).split())
                run = np.fromiter((q["run"] for q in asked), np.int64, len(asked))
                many = run % RUN
                # the windows of all runs, one after another
                ends = np.cumsum(many)
                at = np.repeat(run // RUN - ends + many, many) + np.arange(ends[-1])
                wholes = np.split(hashes.of(sums, 1, at, window).view(np.int64), ends[:-1])
                parts += [(a, b, q["run"], q["mark"], w) for q, w in zip(asked, wholes)]
                held += len(at)
                if held >= ROWS:
                    yield pd.DataFrame(parts, columns=["key_a", "key_b", "run", "mark", "wholes"])
                    parts, held = [], 0
            if parts:
                yield pd.DataFrame(parts, columns=["key_a", "key_b", "run", "mark", "wholes"])

    return rows


def _packed(body: str) -> Column:
    """Texts as they are shuffled: that is done twice, and is most of what is."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(zstandard.ZstdCompressor().compress)

    return pack(body)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows by two hashes of their key and text, 128 bits in all; equal rows have equal ones, and equal results."""
    body = text_of(text)
    return docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(F.lit(1), F.col(key), body).alias("key_a"), F.xxhash64(body, F.col(key), F.lit(2)).alias("key_b"), body.cast("binary").alias("body")
    )


def _written(df: DataFrame) -> DataFrame:
    """:func:`stable`, and then no shuffle files of ``df``: else they stay until the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        # what a frame leaves is settled when it is made
        return stable(df.select("*"))
    finally:
        conf.set(key, before)


def _with_may(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` and ``may``: true where ``key_a`` is one of those in ``keys``, and for a few others that share its bit of a bitmap."""
    bit = F.pmod("key_a", F.lit(BITS))
    page, at = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    pages = keys.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, 1)), 16, 10).cast("long")
    met = rows.withColumn("page", page).join(F.broadcast(pages), "page", "left")
    return met.withColumn("may", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("page", "bits")


def _spans(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    """``key_a, key_b, spans``: for each text with any, its runs of duplicate windows, in no order."""
    # made twice, as a copy of all blocks would take more disk than their text
    blocks = keyed.select("key_a", "key_b", "body").mapInPandas(_blocks(window, anchor), BLOCK)
    marks = blocks.groupBy("mark").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    # written first, so that a join is all that its shuffle is for and hot anchors can be split there
    marks = _written(marks.where("n > 1").select("mark", F.expr("low <> high").alias("mixed")))
    found = _written(blocks.join(marks, "mark"))
    place = ["key_a", "key_b", "run"]
    alike, mixed = found.where("not mixed").select(place), found.where("mixed")
    # of equal blocks any one stands for all
    kinds = _written(mixed.groupBy("mark", "whole").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in place]))
    again = mixed.join(kinds.where("times > 1").select("mark", "whole"), ["mark", "whole"], "left_semi").select(place)
    # different blocks under one anchor may share a window: that is where factors end
    asked = kinds.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("run", "mark")).alias("asked"))
    asked = _written(asked)
    texts = _with_may(keyed, asked).where("may").select("key_a", "key_b", _packed("body").alias("packed"))
    opened = _written(texts.join(asked, ["key_a", "key_b"]).mapInPandas(_windows(window), OPENED))
    windows = opened.select("key_a", "key_b", "run", "mark", F.posexplode("wholes").alias("k", "whole")).withColumn("run", F.expr(f"(run div {RUN} + k) * {RUN} + 1"))
    met = _written(windows.groupBy("mark", "whole").agg(F.count("*").alias("times")).where("times > 1").select("mark", "whole"))
    single = windows.join(met, ["mark", "whole"], "left_semi").select(place)
    return alike.unionByName(again).unionByName(single).groupBy("key_a", "key_b").agg(F.collect_list("run").alias("spans"))


def _covered(runs, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a duplicate window."""
    steps = np.zeros(n + 1, np.int64)
    if runs is not None:
        first, many = np.divmod(np.asarray(runs, np.int64), RUN)
        np.add.at(steps, first, 1)
        np.add.at(steps, first + many + window - 1, -1)
    return np.cumsum(steps[:n]) > 0


def duplicate_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_words, spans`` of every row: the ranges of words, end exclusive, that duplicate windows cover.

    Words are what lies between the characters 0x20 and 0x09 to 0x0D, unchanged.
    A null text has no words, and texts of fewer words than a window no span. A
    window that occurs again in its own text, also overlapping, is a duplicate; so is
    every window of repeated rows and of equal texts. Null keys are keys like
    any other. Other columns are not read.
    """

    @F.pandas_udf("n_words long, spans array<struct<start:int,end:int>>")
    def cover(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out, unpack = [], zstandard.ZstdDecompressor().decompress
        for t, s in zip(texts, spans):
            n = len(unpack(t).split())
            mark = np.diff(np.concatenate(([0], _covered(s, n, window).astype(np.int8), [0])))
            ranges = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(mark == 1), np.flatnonzero(mark == -1))]
            out.append((n, ranges))
        return pd.DataFrame(out, columns=["n_words", "spans"])

    return _with_spans(docs, key, text, window, anchor).select("doc_id", cover("packed", "spans").alias("c")).select("doc_id", "c.*")


def _with_spans(docs: DataFrame, key: str, text: str, window: int, anchor: int) -> DataFrame:
    small_text_batches(docs.sparkSession)
    keyed = _keyed(docs, key, text)
    spans = _written(_spans(keyed, window, anchor))
    texts = _with_may(keyed, spans).select("doc_id", "key_a", "key_b", "may", _packed("body").alias("packed"))
    met = texts.where("may").join(spans, ["key_a", "key_b"], "left").select("doc_id", "packed", "spans")
    return met.unionByName(texts.where("not may").select("doc_id", "packed", F.lit(None).cast("array<long>").alias("spans")))


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row: the words outside of :func:`duplicate_spans`, joined by one space."""

    @F.pandas_udf("n_words long, n_removed long, kept binary")
    def keep(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out, unpack = [], zstandard.ZstdDecompressor().decompress
        for t, s in zip(texts, spans):
            words = unpack(t).split()
            gone = _covered(s, len(words), window)
            removed = int(gone.sum())
            if removed:
                words = [words[k] for k in np.flatnonzero(~gone)]
            out.append((len(gone), removed, b" ".join(words)))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return _with_spans(docs, key, text, window, anchor).select("doc_id", keep("packed", "spans").alias("k")).select(
        "doc_id", "k.n_words", "k.n_removed", F.col("k.kept").cast("string").alias("kept")
    )


def digest(kept: DataFrame) -> DataFrame:
    """Rows of :func:`without_duplicates` with the SHA-256 of what is kept."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
