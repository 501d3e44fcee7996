"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import unicodedata

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that carries whole texts: bounds a Python worker's memory.
TEXT_BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, and read back.

    The folder is the one named by ``spark.checkpoint.dir``. Where the session
    names none, a temporary one is set on a single machine (``local`` masters);
    elsewhere that is an error, as executors don't share such a folder.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def small_text_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, as a batch holds whole texts; batches of numbers stay as long as before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower()
    size = int(now.rstrip("kmgb")) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("b")[-1:], 0)
    if size <= 0 or size > TEXT_BATCH_BYTES:
        spark.conf.set(key, f"{TEXT_BATCH_BYTES}b")


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def packed_text(column: str) -> Column:
    """A text in UTF-8 as it is shuffled where texts are most of what is; null is empty."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(zstandard.ZstdCompressor().compress)

    return pack(text_of(column).cast("binary"))


#: Code points up to U+0377 are all assigned.
BEYOND = re.compile("[^\x00-\u0377]")


def open_points(text: str) -> set[str]:
    """Code points of a text that Unicode leaves open, as Python knows it.

    Newer tables make letters of some of them, and libraries differ in the tables
    they have; texts that hold any are cut with care.
    """
    if text.isascii():
        return set()
    return {c for c in set(BEYOND.findall(text)) if unicodedata.category(c) == "Cn"}
