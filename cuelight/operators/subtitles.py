"""Subtitle files to cues, cues to overlapping dialogue windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions import text as T


def parse_subtitles(files: DataFrame) -> DataFrame:
    """``files(video_id, body)`` of SRT or WebVTT to cues, numbered by start and place.

    Blocks without a timecode, with an end not after the start, or without words
    are dropped. A narrow plan until the numbering, which is by video.
    """
    body = F.regexp_replace(F.regexp_replace(F.coalesce("body", F.lit("")), "^﻿", ""), "\r\n?", "\n")
    blocks = files.select("video_id", F.posexplode(F.split(body, "\n{2,}")).alias("block", "raw"))
    rows = blocks.withColumn("lines", F.split("raw", "\n"))
    at = F.array_position(F.transform("lines", lambda x: x.rlike(T.TIMECODE)), True)
    timed = rows.withColumn("at", at.cast("int")).where("at > 0").withColumn("code", F.get("lines", F.col("at") - 1))
    spoken = F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), "\n")
    cues = timed.select(
        "video_id",
        "block",
        T.timecode_ms(F.col("code"), 1).alias("start_ms"),
        T.timecode_ms(F.col("code"), 5).alias("end_ms"),
        T.clean_cue(spoken).alias("text"),
    ).where("end_ms > start_ms and text <> ''")
    order = Window.partitionBy("video_id").orderBy("start_ms", "block")
    return cues.select("video_id", (F.row_number().over(order) - 1).alias("cue"), "start_ms", "end_ms", "text")


def dialogue_windows(
    cues: DataFrame, max_duration_ms: int = 14_000, max_gap_ms: int = 3_000, max_cues: int = 6, stride: int = 2
) -> DataFrame:
    """Overlapping windows of a video's cues: the unit of embedding and of results.

    From each cue a frame of ``max_cues`` rows tells how far a window reaches. The
    cues that start a window depend on where the window before ended, so they are
    found by a fold over the video's cues, numbers only: a video is one row of
    small structs there, and its texts are joined from the frame afterwards.
    """
    by_video = Window.partitionBy("video_id").orderBy("cue")
    frame = by_video.rowsBetween(0, max_cues - 1)
    ahead = F.collect_list(F.struct("cue", "start_ms", "end_ms", "text")).over(frame)
    reach = F.aggregate(
        F.slice("ahead", 2, max_cues),
        F.struct(F.lit(1).alias("n"), F.get("ahead", 0)["end_ms"].alias("last_end"), F.lit(True).alias("open")),
        lambda acc, c: F.when(
            acc["open"] & (c["start_ms"] - acc["last_end"] <= max_gap_ms) & (c["end_ms"] - F.get("ahead", 0)["start_ms"] <= max_duration_ms),
            F.struct((acc["n"] + 1).alias("n"), c["end_ms"].alias("last_end"), F.lit(True).alias("open")),
        ).otherwise(F.struct(acc["n"].alias("n"), acc["last_end"].alias("last_end"), F.lit(False).alias("open"))),
    )
    total = Window.partitionBy("video_id")
    spans = cues.withColumn("ahead", ahead).withColumn("n_cues", F.count("*").over(total)).withColumn("n", reach["n"])
    spans = spans.select(
        "video_id", "cue", "start_ms", F.slice("ahead", F.lit(1), F.col("n")).alias("parts"), (F.col("cue") + F.col("n") - 1).alias("last"), "n_cues"
    )
    steps = F.array_sort(F.collect_list(F.struct("cue", "last")))
    chosen = (
        spans.groupBy("video_id")
        .agg(steps.alias("steps"), F.max("n_cues").alias("n_cues"))
        .select(
            "video_id",
            F.aggregate(
                "steps",
                F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("starts")),
                lambda acc, s: F.when(
                    s["cue"] == acc["next"],
                    F.struct(
                        F.when(s["last"] >= F.col("n_cues") - 1, -1).otherwise(F.least(s["cue"] + stride, s["last"] + 1)).cast("int").alias("next"),
                        F.concat(acc["starts"], F.array(s["cue"])).alias("starts"),
                    ),
                ).otherwise(acc),
                lambda acc: acc["starts"],
            ).alias("starts"),
        )
        .select("video_id", F.explode("starts").alias("cue"))
    )
    return spans.join(chosen, ["video_id", "cue"]).select(
        "video_id",
        "start_ms",
        F.element_at("parts", -1)["end_ms"].alias("end_ms"),
        T.squeeze(F.array_join(F.transform("parts", lambda c: c["text"]), " ")).alias("text"),
        F.col("cue").alias("first_cue"),
        F.col("last").alias("last_cue"),
    )


def lines_of(windows: DataFrame, title_of: DataFrame) -> DataFrame:
    """Windows as lines of the index; a line's id depends on its place alone, so it survives indexing anew."""
    return windows.join(title_of, "video_id").select(
        F.xxhash64("video_id", "first_cue", "start_ms").alias("line_id"), "video_id", "title_id", "start_ms", "end_ms", "text"
    )
