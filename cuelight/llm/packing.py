"""Best-fit packing of token sequences, bulk-synchronously by rank.

Documents and gaps are integers from 1 to the capacity, so either sorted order
is a few runs of equal sizes. One superstep takes the longest run of documents
that is left and sweeps for the successor among the gaps, the smallest gap that
still holds that length: the ranks of the run meet the ranks of the sequences
with that gap, a sequence with room for several taking consecutive ranks. The
gaps are updated and the sweep repeats until the run is placed; what finds no
gap opens sequences. That is exactly best fit decreasing, for all documents of
a size at once.

The rows never leave the executors. They are counted by size (at most
``capacity`` groups), the supersteps run over those runs, and their outcome, a
table of rank intervals whose size depends on the capacity alone, is joined
back to the ranks. Ranks come from a range sort by size: a size with a large
share of the rows is dealt to buckets in proportion to its share, each counted
and sorted by itself, so no task holds a whole run.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.llm.common import open_points, small_text_batches, stable, text_of

#: Length of a run of non-blanks or blanks that merges slowly by ranks.
LONG_RUN = 1000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Codec:
    """Byte-level BPE of whole texts as little-endian ids, four bytes an id.

    ``tokenizer`` is the file that defines the ids. The same vocabulary as ranks
    gives the same ids for ordinary text at a fourth of the CPU time, so most
    texts are encoded with that. Those that hold the string of a special token, a
    code point that Unicode left open, or a run that the ranks' quadratic merge
    would be slow on, go to the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        with open(ranks, "rb") as f:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def hard(self, text: str) -> bool:
        """Whether a text is one for the tokenizer itself."""
        if any(s in text for s in self.special) or open_points(text):
            return True
        words = text.split()
        blanks = len(text) - sum(map(len, words))
        return max(map(len, words), default=0) >= LONG_RUN or (blanks >= LONG_RUN and re.search(r"\s{%d}" % LONG_RUN, text) is not None)

    def encode(self, text: str) -> bytes:
        if self.hard(text):
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            ids = self.ranks.encode_to_numpy(text, disallowed_special=())
        return ids.astype("<u4").tobytes()


_codecs: dict[str, Codec] = {}


def codec(tokenizer: str, ranks: str) -> Codec:
    if tokenizer not in _codecs:
        _codecs[tokenizer] = Codec(tokenizer, ranks)
    return _codecs[tokenizer]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole ones, after what is over."""
    over = n % capacity
    return ([over] if over else []) + [capacity] * (n // capacity)


def tokenized_pieces(
    docs: DataFrame, files: tuple[str, str], end_id: int, capacity: int, key: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """A row for each piece of each document; with ``keep_ids`` also its ids."""
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(*files).encode
        for batch in batches:
            rows: list[list] = [[] for _ in range(6 if keep_ids else 5)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), map(encode, batch.column(1).to_pylist())):
                ids += tail
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = [doc_id, piece, start, length, zlib.crc32(part)]
                    if keep_ids:
                        row.append(np.frombuffer(part, "<u4").astype(np.int32))
                    for column, value in zip(rows, row):
                        column.append(value)
                    start += length
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names[: len(rows)])

    small_text_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(cut, schema)


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The supersteps over runs of equal sizes.

    Intervals ``(length, rank, ranks, sequence, each, offset)``: ranks ``rank``
    to ``rank + ranks - 1`` of the run of ``length`` go to sequences from
    ``sequence`` on, ``each`` to one, the first of them at ``offset``. Their
    number depends on the capacity, not on the counts.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
    sizes: list[int] = []  # the gaps there are, ascending
    plan, opened = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                each = capacity // length
                gap, first, n = capacity, opened, -(-left // each)
                opened += n
            else:
                gap = sizes[at]
                first, n = gaps[gap].pop()
                each = gap // length
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            full = min(n, left // each)
            placed = full * each
            rest = left - placed if full < n else 0
            plan.append((length, rank, placed + rest, first, each, capacity - gap))
            put(gap - each * length, first, full)
            used = full
            if rest:
                put(gap - rest * length, first + full, 1)
                used += 1
            put(gap, first + used, n - used)
            left -= placed + rest
            rank += placed + rest
    return plan


def pack(pieces: DataFrame, capacity: int = 1024, ranks_dealt: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` must be stable.

    ``ranks_dealt`` buckets share the rows in proportion to the runs, one at
    least a run; one bucket is sorted in one task.
    """
    spark = pieces.sparkSession
    runs = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    total = max(1, sum(runs.values()))
    dealt = [(length, -(-ranks_dealt * n // total)) for length, n in runs.items()]
    plan = best_fit_runs(runs, capacity)
    dealt_df = F.broadcast(spark.createDataFrame(dealt, "length long, buckets int")) if dealt else spark.createDataFrame([], "length long, buckets int")
    steps = spark.createDataFrame(plan, "length long, from_rank long, ranks long, sequence long, each long, at long")
    spread = pieces.join(dealt_df, "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("buckets"))
    )
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        spread.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = spread.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(base), ["length", "bucket"]).withColumn(
        "rank", F.col("rank") + F.col("base")
    )
    placed = ranked.join(
        F.broadcast(steps),
        (ranked["length"] == steps["length"]) & ranked["rank"].between(steps["from_rank"], steps["from_rank"] + steps["ranks"] - 1),
    ).drop(steps["length"])
    back = F.col("rank") - F.col("from_rank")
    kept = [c for c in pieces.columns]
    return placed.select(
        *kept,
        (F.col("sequence") + F.floor(back / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(back, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, files: tuple[str, str], end_id: int = 2, capacity: int = 1024, key: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Pieces of all ``docs`` with their places in sequences of at most ``capacity`` ids.

    ``files`` are the tokenizer's file and the same vocabulary as ranks.
    A null or empty text is its end id alone. Texts over the capacity are cut,
    what is over coming first. Repeated rows are packed once each. An empty
    table gives an empty result. Other columns are not read.
    """
    return pack(stable(tokenized_pieces(docs, files, end_id, capacity, key, text, keep_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, input_ids`` of pieces packed with ``keep_ids``.

    A sequence has at most the capacity in ids, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("input_ids"))


def byte_bpe_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def best_fit_bound(spark: SparkSession, packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """Sequences used and the fewest that the token count allows."""
    return packed.agg(
        F.countDistinct("sequence_id").alias("used"), F.ceil(F.sum("length") / F.lit(capacity)).cast("long").alias("least")
    )
