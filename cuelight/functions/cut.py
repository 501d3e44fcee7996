"""Interval and geometry expressions for clips, trimming, captions and filmstrips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CLIP, MAX_PAD, SNAP, GRACE = 250, 15_000, 400, 150
TILE_MS, MAX_TILES = 500, 96


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clip_start(match_start: Column, pad_before: Column) -> Column:
    return F.greatest(F.lit(0), match_start - pad_before)


def clip_end(match_start: Column, match_end: Column, pad_before: Column, pad_after: Column) -> Column:
    """End of a clip, which is never shorter than the least length."""
    start, end = clip_start(match_start, pad_before), match_end + pad_after
    return F.when(end - start < MIN_CLIP, start + MIN_CLIP).otherwise(end)


def window_start(match_start: Column) -> Column:
    return F.greatest(F.lit(0), match_start - MAX_PAD)


def window_end(match_end: Column) -> Column:
    return match_end + MAX_PAD


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, x))


def snap(value: Column, points: Column, tolerance: int = SNAP) -> Column:
    """The nearest of sorted ``points`` strictly within ``tolerance``, the first of equals; else the value."""
    best = F.aggregate(
        points,
        F.struct(F.lit(None).cast("long").alias("at"), F.lit(tolerance).cast("long").alias("off")),
        lambda acc, p: F.when(F.abs(p - value) < acc["off"], F.struct(p.cast("long").alias("at"), F.abs(p - value).cast("long").alias("off"))).otherwise(acc),
    )
    return F.coalesce(best["at"], value)


def next_boundary(points: Column, at: Column, forward: bool) -> Column:
    """The first of sorted ``points`` over a millisecond past ``at``, or the last before it; null for none."""
    if forward:
        return F.get(F.filter(points, lambda p: p > at + 1), 0)
    return F.try_element_at(F.filter(points, lambda p: p < at - 1), F.lit(-1))


def tiles(start: Column, end: Column) -> Column:
    return clamp(half_up(F.greatest(F.lit(TILE_MS), end - start) / TILE_MS), F.lit(1), F.lit(MAX_TILES)).cast("int")


def tile_interval(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(TILE_MS), end - start) / tiles(start, end)


def tile_at(start: Column, end: Column, at: Column) -> Column:
    return clamp(F.floor((at - start) / tile_interval(start, end)), F.lit(0), tiles(start, end) - 1).cast("int")


def position_percent(start: Column, end: Column, at: Column) -> Column:
    return F.when(end > start, clamp((at - start) / (end - start) * 100, F.lit(0.0), F.lit(100.0))).otherwise(0.0)


def caption_size(size: Column) -> Column:
    return F.when(size.isNull() | F.isnan(size) | (F.abs(size) == float("inf")), 1.0).otherwise(clamp(size, F.lit(0.5), F.lit(3.0)))


def ass_time(ms: Column) -> Column:
    """``h:mm:ss.cc``, rounded down."""
    t = F.greatest(F.lit(0), ms)
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(
        F.floor(t / 3_600_000).cast("string"), F.lit(":"), pad(F.floor(t / 60_000) % 60), F.lit(":"), pad(F.floor(t / 1000) % 60), F.lit("."), pad(F.floor(t / 10) % 100)
    )


def ass_text(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(F.replace(text, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    return F.regexp_replace(text, r"\r?\n", r"\\N")


def edge_limits(edge: str, match_start: Column, match_end: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Least and greatest place of the ``start`` or ``end`` edge: in the window, a shortest clip off the other edge."""
    if edge == "start":
        return window_start(match_start), end - MIN_CLIP
    return start + MIN_CLIP, window_end(match_end)


def move_edge(edge: str, to: Column, match_start: Column, match_end: Column, start: Column, end: Column) -> Column:
    lo, hi = edge_limits(edge, match_start, match_end, start, end)
    return half_up(F.least(hi, F.greatest(lo, to)))


def move_clip(by: Column, match_start: Column, match_end: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Both edges moved by the same, as far as the window lets them: the length stays."""
    held = clamp(by, window_start(match_start) - start, window_end(match_end) - end)
    return start + held, end + held


def tile_offset_percent(index: Column, count: Column) -> Column:
    return F.when(count > 1, index / (count - 1) * 100).otherwise(0.0)


def spine_tiles(count: Column, wanted: Column) -> Column:
    """Evenly spread tiles, the first and the last among them."""
    n = clamp(wanted, F.lit(1), count)
    return F.when(n == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: half_up(i / (n - 1) * (count - 1)).cast("int"))
    )


def time_at_percent(start: Column, end: Column, percent: Column) -> Column:
    return start + (end - start) * clamp(percent, F.lit(0.0), F.lit(100.0)) / 100


def cue_key(start: Column) -> Column:
    return half_up(start).cast("long").cast("string")


def caption_style(height: Column, meme: Column, size: Column, placement: Column) -> Column:
    """Font, outline, margin and alignment of a caption, all growing with the picture."""
    by = lambda big, small: F.when(meme, big).otherwise(small)
    held = caption_size(size)
    top = F.when(placement == "auto", meme).otherwise(placement == "top")
    return F.struct(
        half_up(height * by(0.085, 0.055) * held).cast("int").alias("font"),
        F.greatest(F.lit(2), half_up(height * by(0.006, 0.004) * held)).cast("int").alias("outline"),
        half_up(height * by(0.04, 0.035)).cast("int").alias("margin"),
        F.when(top, 8).otherwise(2).alias("alignment"),
        F.when(meme, -1).otherwise(0).alias("bold"),
    )
