"""Which audio track clips of a video carry, looked up once.

What a video's row doesn't say is asked of the catalogue and written back to a
log, -1 where the catalogue names none, so it is never asked again. Reads take
the newest entry of a video.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.operators.library import pick_audio
from cuelight.sources import commits as C

NONE = -1


def known_indexes(spark: SparkSession, out: str) -> DataFrame:
    """``video_id, audio_index`` of the log, -1 for videos that have none."""
    kept = C.committed(spark, out, "audio")
    return spark.createDataFrame([], "video_id string, audio_index int") if kept is None else C.newest(kept, "video_id", ["audio_index"]).drop("batch")


def audio_indexes(spark: SparkSession, out: str, videos: DataFrame, lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``video_id, audio_index`` of ``videos(video_id, audio_index)``: their own, else the log's, else what ``lookup`` finds; null for none.

    ``lookup`` takes ``video_id`` of those that nothing is known of and gives
    ``video_id, sources`` in the catalogue's form; videos it leaves out have none.
    """
    told = videos.join(known_indexes(spark, out).withColumnRenamed("audio_index", "__memo"), "video_id", "left")
    open_ones = told.where("audio_index is null and __memo is null").select("video_id").distinct()
    if not open_ones.isEmpty():
        found = lookup(open_ones)
        streams = F.flatten(F.transform(F.coalesce("sources", F.array().cast(dict(found.dtypes)["sources"])), lambda s: s["streams"]))
        picked = found.select("video_id", pick_audio(streams).cast("int").alias("picked")).groupBy("video_id").agg(F.min("picked").alias("picked"))
        C.append(spark, out, "audio", open_ones.join(picked, "video_id", "left").select("video_id", F.coalesce("picked", F.lit(NONE)).alias("audio_index")))
        told = videos.join(known_indexes(spark, out).withColumnRenamed("audio_index", "__memo"), "video_id", "left")
    index = F.coalesce("audio_index", "__memo")
    return told.select("video_id", F.when(index >= 0, index).alias("audio_index"))


def compact(spark: SparkSession, out: str) -> None:
    """The log as one whole batch."""
    batch = C.next_batch(spark, out)
    known_indexes(spark, out).write.mode("overwrite").parquet(f"{out}/audio/batch={batch}")
    C.commit(spark, out, batch, whole=True)
