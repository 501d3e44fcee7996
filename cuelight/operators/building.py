"""Pasted text to a cut: split, read, searched in one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.functions import vectors as V
from cuelight.operators import editing, retrieval
from cuelight.operators.hints import read_requests, scope_of
from cuelight.operators.splitting import split_descriptions

#: Matches that a clip keeps to choose from, and descriptions of one paste.
ALTERNATES, DESCRIPTIONS = 6, 60


def build_cuts(
    pastes: DataFrame, lines: DataFrame, videos: DataFrame | None = None, embed: Callable[[Column], Column] = V.hash_embedding, min_idf: float = retrieval.MIN_IDF
) -> DataFrame:
    """``doc_id, pos, query_id, clip`` for each description of ``pastes(doc_id, text)``.

    A description that finds nothing stays, as a clip without a match. With
    ``videos(video_id, name, season, episode, runtime_ms)`` an episode that a
    description names comes first. ``lines`` have vectors of the same ``embed``.
    """
    found = split_descriptions(pastes, videos).withColumn("query_id", F.col("doc_id") * DESCRIPTIONS + F.col("pos"))
    asked = found.select("query_id", F.col("description").alias("text"))
    if videos is None:
        wanted = asked.withColumn("embedding", embed(F.col("text")))
        matches = retrieval.hybrid_search(lines, wanted, ALTERNATES, min_idf)
    else:
        requests = read_requests(asked, videos).withColumn("embedding", embed(F.col("text")))
        matches = retrieval.hybrid_search(lines, requests, ALTERNATES, min_idf, prefer=scope_of(requests, videos), videos=videos)
    one = F.struct("place", "line_id", "title_id", "video_id", "start_ms", "end_ms", "score")
    alternates = matches.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("alternates"))  # at most ALTERNATES
    joined = found.join(alternates, "query_id", "left")
    none = F.slice(F.array(F.struct(*[F.lit(None).cast(t).alias(c) for c, t in dict(matches.select("place", "line_id", "title_id", "video_id", "start_ms", "end_ms", "score").dtypes).items()])), 1, 0)
    return joined.select("doc_id", "pos", "query_id", editing.new_clip(F.col("description"), F.coalesce("alternates", none)).alias("clip"))


def saved_cuts(clips: DataFrame) -> DataFrame:
    """``doc_id, clips``: the clips of each cut in order, as they are written in one row."""
    return clips.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "clip"))).alias("clips"))  # at most DESCRIPTIONS


def reviewed_descriptions(pastes: DataFrame) -> DataFrame:
    """``doc_id, pos, description`` of the array ``reviewed``: trimmed, blank ones out, the first :data:`DESCRIPTIONS`."""
    told = F.slice(F.filter(F.transform("reviewed", T.trimmed), lambda t: t != ""), 1, DESCRIPTIONS)
    return pastes.where("reviewed is not null").select("doc_id", F.posexplode(told).alias("pos", "description"))


def build_montages(
    pastes: DataFrame,
    lines: DataFrame,
    videos: DataFrame,
    now_ms: int,
    embed: Callable[[Column], Column] = V.hash_embedding,
    min_idf: float = retrieval.MIN_IDF,
    stemmed: bool = True,
) -> DataFrame:
    """A cut for each of ``pastes(doc_id, title_id, text)``, as a row to be saved.

    Descriptions are those of the array ``reviewed`` where a paste has one, else what
    its text is split into; they are read and searched within the paste's
    title, all in one batch. A ``name`` is trimmed; without one it is the time of building. The
    text is kept as it was pasted. A paste without descriptions is a cut without
    clips, and a description that finds nothing a clip without matches.
    """
    reviewed = "reviewed" in pastes.columns
    found = split_descriptions(pastes.where("reviewed is null") if reviewed else pastes, videos)
    if reviewed:
        found = found.unionByName(reviewed_descriptions(pastes))
    found = found.withColumn("query_id", F.col("doc_id") * DESCRIPTIONS + F.col("pos")).join(pastes.select("doc_id", "title_id"), "doc_id")
    asked = found.select("query_id", F.col("description").alias("text"), "title_id")
    matches = retrieval.scene_search(lines, videos, asked, ALTERNATES, embed, min_idf, stemmed)
    one = F.struct("place", "line_id", "title_id", "video_id", "start_ms", "end_ms", "score")
    alternates = matches.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("alternates"))  # at most ALTERNATES
    where = read_requests(asked, videos.where("title_id is not null")).select("query_id", "label")
    joined = found.join(alternates, "query_id", "left").join(where, "query_id", "left")
    kind = dict(alternates.dtypes)["alternates"]
    clip = editing.new_clip(F.col("description"), F.coalesce("alternates", F.array().cast(kind)), where=F.col("label"))
    clips = joined.select("doc_id", "pos", clip.alias("clip")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "clip"))).alias("c"))  # at most DESCRIPTIONS
    name = F.nullif(T.trimmed(F.col("name")), F.lit("")) if "name" in pastes.columns else F.lit(None).cast("string")
    at = F.date_format(F.timestamp_millis(F.lit(now_ms)), "yyyy-MM-dd HH:mm:ss")
    none = F.array().cast(f"array<{dict(joined.select(clip.alias('clip')).dtypes)['clip']}>")
    return pastes.join(clips, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        "title_id",
        F.coalesce(name, F.concat(F.lit("Montage "), at)).alias("name"),
        F.coalesce("text", F.lit("")).alias("source_text"),
        F.coalesce(F.transform("c", lambda c: c["clip"]), none).alias("clips"),
        F.lit(now_ms).cast("long").alias("created_at"),
        F.lit(now_ms).cast("long").alias("updated_at"),
    )
