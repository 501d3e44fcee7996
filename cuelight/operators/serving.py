"""Lookups, guards, limits and addresses around the library."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions import text as T

#: Most results of a search, of a search for one clip, and their defaults.
SEARCH_LIMIT, CLIP_LIMIT = (8, 25), (6, 20)
MOST_SCENES = 60
BIT_RATES = (1_500_000, 12_000_000)
#: Width of a preview and height of a title's picture where none is asked for.
PREVIEW_WIDTH, IMAGE_HEIGHT = 640, 400


class NotIndexed(LookupError):
    """The library, or the title that was asked for, has no lines yet."""


class NoSuchItem(LookupError):
    """No item has the id."""


def multi_get(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items of ``ids(id)``, each once; no ids, no items."""
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def get_item(items: DataFrame, item_id: str) -> DataFrame:
    found = items.where(F.col("id") == item_id).limit(1)
    if found.isEmpty():
        raise NoSuchItem(item_id)
    return found


def children(titles: DataFrame, episodes: DataFrame) -> DataFrame:
    """Videos of each title: a film is its own, a series has its episodes."""
    films = titles.where("kind = 'Movie'").select(F.col("id").alias("title_id"), F.col("id").alias("video_id"), "name")
    series = titles.where("kind = 'Series'").select(F.col("id").alias("title_id"))
    return films.unionByName(episodes.join(series, "title_id").select("title_id", "video_id", "name"))


def require_indexed(titles: DataFrame, title_id: str | None = None) -> None:
    """Raise where a search could find nothing."""
    scope = titles if title_id is None else titles.where(F.col("id") == title_id)
    row = scope.agg(F.count("*").alias("n"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total")).first()
    if title_id is not None and not row.n:
        raise NoSuchItem(title_id)
    if not row.total:
        raise NotIndexed(title_id or "library")


def limit_of(asked: int | None, limits: tuple[int, int] = SEARCH_LIMIT) -> int:
    return min(limits[0] if asked is None else asked, limits[1])


def reviewed(lists: DataFrame, most: int = MOST_SCENES) -> DataFrame:
    """``lists(cut_id, texts)`` as given by hand: trimmed, without blanks, the first ``most``."""
    kept = F.filter(F.transform("texts", T.trimmed), lambda t: t != "")
    return lists.select("cut_id", F.slice(kept, 1, most).alias("texts"))


def chosen_scenes(cuts: DataFrame) -> DataFrame:
    """``cuts(cut_id, alternates, chosen)`` to a clip for each chosen place that there is."""
    return (
        cuts.select("cut_id", "alternates", F.posexplode("chosen").alias("pos", "alternate_index"))
        .where((F.col("alternate_index") >= 0) & (F.col("alternate_index") < F.size("alternates")))
        .select("cut_id", "pos", "alternate_index", F.get("alternates", F.col("alternate_index")).alias("match"))
    )


def primary_source(sources: Column) -> Column:
    return F.get(sources, 0)["id"]


def video_stream(sources: Column) -> Column:
    """The first picture stream of the first source."""
    return F.get(F.filter(F.get(sources, 0)["streams"], lambda s: s["type"] == "Video"), 0)


def segment_url(base: Column, video_id: Column, source_id: Column, start_ticks: Column, width: Column) -> Column:
    """Address of a transcoded segment: the bit rate follows the width between two bounds, and nothing is copied as is."""
    rate = F.greatest(F.lit(BIT_RATES[0]), F.least(F.lit(BIT_RATES[1]), width * 8000))
    query = F.concat_ws(
        "&",
        F.concat(F.lit("mediaSourceId="), F.url_encode(source_id)),
        F.concat(F.lit("startTimeTicks="), start_ticks.cast("string")),
        F.concat(F.lit("maxWidth="), width.cast("string")),
        F.concat(F.lit("videoBitRate="), rate.cast("string")),
        F.lit("allowVideoStreamCopy=false"),
    )
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/Videos/"), F.url_encode(video_id), F.lit("/stream?"), query)


def _address(base: Column, path: list[Column | str], parameters: dict[str, Column | str | None]) -> Column:
    """An address with its parameters in order, those that are null left out."""
    text = lambda v: F.lit(v) if isinstance(v, str) else v.cast("string")
    told = [F.concat(F.lit(f"{k}="), F.url_encode(text(v))) for k, v in parameters.items() if v is not None]
    parts = [F.lit(x) if isinstance(x, str) else F.url_encode(x) for x in path]
    return F.concat(F.regexp_replace(base, "/+$", ""), *parts, F.lit("?"), F.concat_ws("&", *told))


def stream_url(base: Column, video_id: Column, source_id: Column, key: Column) -> Column:
    """Address of the file as it is, which a reader can seek in; null sources are left to the server."""
    return _address(base, ["/Videos/", video_id, "/stream"], {"static": "true", "mediaSourceId": source_id, "ApiKey": key})


def preview_url(base: Column, video_id: Column, start_ms: Column, key: Column, width: int = PREVIEW_WIDTH, audio: Column | None = None, device: str = "preview") -> Column:
    """Address of a film that a browser plays, made on the way where it must be, from ``start_ms`` on."""
    fixed = {"static": "false", "container": "mp4", "videoCodec": "h264", "audioCodec": "aac", "allowVideoStreamCopy": "true", "allowAudioStreamCopy": "true", "enableAutoStreamCopy": "true"}
    ticks = F.floor(start_ms * 10_000 + F.lit(0.5)).cast("long")
    return _address(base, ["/Videos/", video_id, "/stream.mp4"], {**fixed, "maxWidth": str(width), "startTimeTicks": ticks, "deviceId": device, "AudioStreamIndex": audio, "ApiKey": key})


def image_url(base: Column, item_id: Column, key: Column, height: int = IMAGE_HEIGHT) -> Column:
    return _address(base, ["/Items/", item_id, "/Images/Primary"], {"maxHeight": str(height), "ApiKey": key})


def size_text(size: Column) -> Column:
    """Bytes in units of 1024: whole bytes, else one digit after the point."""
    power = F.when(size >= 1 << 30, 3).when(size >= 1 << 20, 2).when(size >= 1 << 10, 1).otherwise(0)
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), power + 1)
    return F.when(power == 0, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", size / F.pow(F.lit(1024.0), power)), F.lit(" "), unit))


def setting(stored: dict[str, str], name: str, variable: str) -> str | None:
    """A setting as stored, else from the environment; addresses lose their closing slashes."""
    value = stored.get(name) or os.environ.get(variable) or None
    return value.rstrip("/") if value and "://" in value else value
