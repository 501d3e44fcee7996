"""Clips of a cut over the cues of their videos: alternates, trimming, captions and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions import cut as C
from cuelight.functions import text as T
from cuelight.operators import intervals

#: The longest span that clip cues are given for.
MOST_SPAN_MS = 120_000


def with_cues(marks: DataFrame, cues: DataFrame, key: list[str]) -> DataFrame:
    """``marks(video_id, key, lo, hi, …)`` with the array ``cues`` of what their video says from ``lo`` to ``hi``, in order."""
    return intervals.with_near(marks, cues.select("video_id", "start_ms", "end_ms", "cue", "text"), key, "cues")


def reach(start: Column, end: Column, match_start: Column, match_end: Column) -> tuple[Column, Column]:
    """From where to where cues matter to a clip: the window its edges may move in, and what they snap to from there."""
    return (
        F.least(start, end, C.window_start(match_start)) - C.SNAP,
        F.greatest(start, end, C.window_end(match_end)) + C.SNAP,
    )


def edge_points(cues: DataFrame) -> DataFrame:
    """``video_id, p``: where cues start and end."""
    return cues.select("video_id", F.explode(F.array("start_ms", "end_ms")).alias("p"))


def alternates_of_title(matches: Column, picked: Column, title: str = "title") -> Column:
    """``struct<title, places, chosen>``: of the first valid pick's title, where its matches stand, and the picks among those.

    Picks are 0-based places in ``matches``; those of other titles are dropped.
    Null where no pick is valid.
    """
    valid = F.filter(picked, lambda i: (i >= 0) & (i < F.size(matches)))
    own = F.get(matches, F.get(valid, 0))[title]
    places = F.filter(F.transform(matches, lambda x, i: F.when(x[title] == own, i)), lambda i: i.isNotNull())
    chosen = F.filter(F.transform(valid, lambda i: F.array_position(places, i) - 1), lambda i: i >= 0)
    return F.when(F.size(valid) > 0, F.struct(own.alias("title"), places.alias("places"), chosen.alias("chosen")))


def resolve_caption(clip_mode: Column, clip_text: Column, cut_mode: Column, cut_text: Column, size: tuple[Column, Column], placement: tuple[Column, Column]) -> Column:
    """``struct<mode, text, size, placement>``: mode and text of the clip unless it inherits, looks by clip, cut, default."""
    inherits = clip_mode == "inherit"
    return F.struct(
        F.when(inherits, cut_mode).otherwise(clip_mode).alias("mode"),
        F.when(inherits, cut_text).otherwise(clip_text).alias("text"),
        C.caption_size(F.coalesce(*size, F.lit(1.0)).cast("double")).alias("size"),
        F.coalesce(*placement, F.lit("auto")).alias("placement"),
    )


def boundaries(cues: Column, *more: Column) -> Column:
    """Sorted places where an edge may snap: starts and ends of cues, and ``more``."""
    return F.array_sort(F.array_distinct(F.concat(F.array(*more), F.transform(cues, lambda c: c["start_ms"]), F.transform(cues, lambda c: c["end_ms"]))))


def trim_actions(cues: Column, start: Column, end: Column, match_start: Column, match_end: Column) -> Column:
    """``array<struct<key, to>>``: what can be done to a clip: a line added at either side, or dropped there, within reach.

    A line counts as outside when it is by no more than ``GRACE`` inside; one is
    dropped only where several are inside.
    """
    g = C.GRACE
    lo, hi = C.window_start(match_start), C.window_end(match_end)
    start_ok = lambda x: (x >= lo) & (x <= end - C.MIN_CLIP)
    end_ok = lambda x: (x <= hi) & (x >= start + C.MIN_CLIP)
    before = F.try_element_at(F.filter(cues, lambda x: x["end_ms"] <= start + g), F.lit(-1))["start_ms"]
    after = F.get(F.filter(cues, lambda x: x["start_ms"] >= end - g), 0)["end_ms"]
    inside = F.filter(cues, lambda x: (x["end_ms"] > start + g) & (x["start_ms"] < end - g))
    first, last = F.get(inside, 0)["end_ms"], F.try_element_at(inside, F.lit(-1))["start_ms"]
    several = F.size(inside) > 1
    act = lambda key, to, ok: F.when(ok, F.struct(F.lit(key).alias("key"), to.alias("to")))
    return F.array_compact(
        F.array(
            act("add-before", before, start_ok(before)),
            act("drop-first", first, several & start_ok(first)),
            act("drop-last", last, several & end_ok(last)),
            act("add-after", after, end_ok(after)),
        )
    )


def apply_line_edits(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """Cues with the texts of ``edits(video_id, edits map<string,string>)`` by cue key, empty ones too; others are ignored."""
    joined = cues.join(edits.select("video_id", F.col("edits").alias("__edits")), "video_id", "left")
    return joined.withColumn("text", F.coalesce(F.try_element_at("__edits", C.cue_key(F.col("start_ms"))), F.col("text"))).drop("__edits")


def clip_events(cues: Column, start: Column, end: Column) -> Column:
    """``array<struct<cue, start_ms, end_ms, text>>``: the cues that overlap a clip, in the clip's own time and held to it."""
    inside = F.filter(cues, lambda x: (x["end_ms"] > start) & (x["start_ms"] < end))
    return F.transform(
        inside,
        lambda x: F.struct(
            x["cue"].alias("cue"),
            F.greatest(F.lit(0), x["start_ms"] - start).alias("start_ms"),
            F.least(end - start, x["end_ms"] - start).alias("end_ms"),
            x["text"].alias("text"),
        ),
    )


def cues_between(cues: DataFrame, video_id: str, start_ms: int, end_ms: int) -> DataFrame:
    """The cues of a video that overlap a span, which is held to ``MOST_SPAN_MS``."""
    until = min(end_ms, start_ms + MOST_SPAN_MS)
    return cues.where((F.col("video_id") == video_id) & (F.col("end_ms") > start_ms) & (F.col("start_ms") < until)).orderBy("start_ms", "cue")


def drawable(event: Column) -> Column:
    """Whether an event shows anything."""
    return (T.trimmed(event["text"]) != "") & (event["end_ms"] > event["start_ms"])


def dialogue_line(event: Column, meme: Column | None = None) -> Column:
    """The line of a caption file for an event; memes are in capitals."""
    text = event["text"] if meme is None else F.when(meme, F.upper(event["text"])).otherwise(event["text"])
    return F.concat(F.lit("Dialogue: 0,"), C.ass_time(event["start_ms"]), F.lit(","), C.ass_time(event["end_ms"]), F.lit(",Default,,0,0,0,,"), C.ass_text(text))


# Sections and columns of a caption file.
SCRIPT = ("ScriptType: v4.00+", "PlayResX: %d", "PlayResY: %d", "WrapStyle: 0", "ScaledBorderAndShadow: yes", "YCbCr Matrix: TV.709")
STYLE_COLUMNS = (
    "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, "
    "ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
)
EVENT_COLUMNS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
WHITE, BLACK, FONT = "&H00FFFFFF", "&H00000000", "DejaVu Sans"


def caption_file(events: Column, width: Column, height: Column, meme: Column, size: Column, placement: Column, font: str = FONT) -> Column:
    """A whole caption file: script, style and a line for each event that shows anything; null where none does."""
    look = C.caption_style(height, meme, size, placement)
    side = C.half_up(width * 0.06).cast("string")
    style = F.concat_ws(
        ",",
        F.lit("Style: Default"), F.lit(font), look["font"].cast("string"), *map(F.lit, (WHITE, WHITE, BLACK, BLACK)), look["bold"].cast("string"),
        F.lit("0,0,0,100,100,0,0,1"), look["outline"].cast("string"), F.lit("0"), look["alignment"].cast("string"), side, side, look["margin"].cast("string"), F.lit("1"),
    )
    head = F.concat(
        F.format_string("[Script Info]\n" + "\n".join(SCRIPT), width, height), F.lit(f"\n\n[V4+ Styles]\nFormat: {STYLE_COLUMNS}\n"), style, F.lit(f"\n\n[Events]\nFormat: {EVENT_COLUMNS}\n")
    )
    shown = F.filter(events, drawable)
    lines = F.array_join(F.transform(shown, lambda e: dialogue_line(e, meme)), "\n")
    return F.when(F.size(shown) > 0, F.concat(head, lines, F.lit("\n")))


def caption_events(mode: Column, text: Column, cues: Column, start: Column, end: Column) -> Column:
    """What a caption of a mode shows in a clip: nothing, the cues said in it, or one text all through."""
    whole = F.array(F.struct(F.lit(0).cast("int").alias("cue"), F.lit(0).cast("long").alias("start_ms"), (end - start).cast("long").alias("end_ms"), text.alias("text")))
    said = F.transform(
        clip_events(cues, start, end),
        lambda e: F.struct(e["cue"].cast("int").alias("cue"), e["start_ms"].cast("long").alias("start_ms"), e["end_ms"].cast("long").alias("end_ms"), e["text"].alias("text")),
    )
    return F.when(mode == "subtitle", said).when(mode == "custom", whole).otherwise(F.slice(whole, 1, 0))


def strip_address(video_id: Column, start: Column, end: Column, width: int = 128, height: int = 72) -> Column:
    """The address of a filmstrip by all that it depends on."""
    parts = [c.cast("string") for c in (video_id, start, end, C.tiles(start, end), F.lit(width), F.lit(height))]
    return F.sha1(F.concat_ws("|", *parts))


def summary(clips: DataFrame, by: str = "cut_id") -> DataFrame:
    """``by, n_clips, duration_ms, clock`` of ``clips(by, start_ms, end_ms)``; clips without a match don't count."""
    kept = clips.where("start_ms is not null and end_ms is not null")
    total = kept.groupBy(by).agg(F.count("*").alias("n_clips"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return total.select("*", T.clock(F.col("duration_ms")).alias("clock"))
