"""Subtitle files as a table, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIX = r"([^/]+)\.(?:srt|vtt)$"


def _named(files: DataFrame) -> DataFrame:
    return files.select(
        F.regexp_extract(F.url_decode("path"), SUFFIX, 1).alias("video_id"), F.decode("content", "UTF-8").alias("body"), "modificationTime"
    )


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """``video_id, body, modificationTime`` of every ``.srt`` and ``.vtt`` under ``path``; the name is the video's id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{srt,vtt}").option("recursiveFileLookup", "true").load(path)
    return _named(files)


def stream_subtitles(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.{srt,vtt}")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    return _named(files)
