"""Cuts as tables: naming, lists of clips, edits, captions and render plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions import text as T

#: Width and frames a second of an export: least, most, default for animations and for films.
WIDTH, FPS = (160, 1920, 480, 720), (5, 60, 15, 24)
#: Most characters of one edited line, and of all edits of a clip.
EDIT_CHARS, EDITS_CHARS = 300, 8000
#: Milliseconds around a match that a clip begins with.
PAD_BEFORE_MS, PAD_AFTER_MS = 1000, 1000


def cut_name(query: Column, scenes: Column, video: Column, start_ms: Column) -> Column:
    """A cut's name: what was asked and how many scenes, or the video and the time of its only clip."""
    asked = F.concat(query, F.lit(" · "), scenes.cast("string"), F.lit(" scenes"))
    shown = F.concat(video, F.lit(" · "), T.clock(start_ms))
    return F.when((scenes > 1) & (T.trimmed(query) != ""), asked).otherwise(F.coalesce(shown, F.lit("Untitled clip")))


def insert_at(items: Column, at: Column, item: Column) -> Column:
    """An array with ``item`` at the 0-based place ``at``, held to its ends."""
    place = F.greatest(F.lit(0), F.least(F.size(items), at))
    return F.concat(F.slice(items, F.lit(1), place), F.array(item), F.slice(items, place + 1, F.size(items)))


def swap_neighbours(items: Column, at: Column) -> Column:
    """An array with the items at ``at`` and after it swapped; unchanged where there are no two."""
    ok = (at >= 0) & (at + 1 < F.size(items))
    return F.when(
        ok, F.concat(F.slice(items, F.lit(1), at), F.slice(items, at + 2, F.lit(1)), F.slice(items, at + 1, F.lit(1)), F.slice(items, at + 3, F.size(items)))
    ).otherwise(items)


def replace_at(items: Column, at: Column, item: Column) -> Column:
    """An array with the item at ``at`` replaced; unchanged where there is none."""
    return F.transform(items, lambda x, i: F.when(i == at, item).otherwise(x))


def remove_at(items: Column, at: Column) -> Column:
    return F.filter(items, lambda x, i: i != at)


def new_clip(description: Column, alternates: Column, mode: str = "inherit", where: Column | None = None) -> Column:
    """A clip as it begins: its first match, room around it, the caption of the cut, and where its description said to look."""
    return F.struct(
        description.alias("description"), alternates.alias("alternates"), F.when(F.size(alternates) > 0, 0).alias("alternate_index"),
        F.lit(PAD_BEFORE_MS).cast("long").alias("pad_before_ms"), F.lit(PAD_AFTER_MS).cast("long").alias("pad_after_ms"), F.lit(mode).alias("caption_mode"), F.lit(False).alias("muted"),
        (F.lit(None) if where is None else where).cast("string").alias("where"),
    )


def clear_overrides(clips: Column, caption: str = "caption") -> Column:
    """Clips with the caption of the cut again: mode, text and look go, edited lines stay."""
    cleared = lambda c: F.struct(F.lit("inherit").alias("mode"), F.lit("").alias("text"), F.lit(None).cast("string").alias("look"), c[caption]["lines"].alias("lines"))
    return F.transform(clips, lambda c: c.withField(caption, cleared(c)))


def unmatched(clips: Column, lost: str) -> Column:
    """Clips that no line was found for, by their flag ``lost``."""
    return F.size(F.filter(clips, lambda c: c[lost])).cast("long")


def overridden(clips: Column, own: str) -> Column:
    """Clips with a caption of their own, by their flag ``own``."""
    return F.size(F.filter(clips, lambda c: c[own])).cast("long")


def save_patch(cuts: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cuts with what their patches give; what a patch leaves null stays."""
    p = patches.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return cuts.join(p, key, "left").select(
        *[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in cuts.columns]
    )


def canonical_edits(edits: Column) -> Column:
    """Edits as JSON with sorted keys, so equal edits give one address; null where any is too long."""
    entries = F.array_sort(F.map_entries(edits))
    long_one = F.exists(entries, lambda e: F.length(e["value"]) > EDIT_CHARS)
    total = F.aggregate(entries, F.lit(0), lambda n, e: n + F.length(e["value"]))
    return F.when(~long_one & (total <= EDITS_CHARS), F.to_json(F.map_from_entries(entries)))


def keep_real_edits(edits: Column, original: Column) -> Column:
    """Edits without those that equal the line they are of."""
    return F.map_filter(edits, lambda k, v: ~v.eqNullSafe(F.try_element_at(original, k)))


def changed_lines(edits: Column, shown: Column) -> Column:
    """How many of the lines ``shown`` (an array of their keys) are edited."""
    return F.size(F.filter(shown, lambda k: F.map_contains_key(edits, k)))


def put_back(edits: Column, shown: Column) -> Column:
    """Edits without those of the lines ``shown``; edits of lines out of view stay."""
    return F.map_filter(edits, lambda k, v: ~F.array_contains(shown, k))


def render_settings(kind: Column, width: Column, fps: Column) -> Column:
    """Width, frames a second and whether there is sound, for a kind of export."""
    moving_picture = kind.isin("gif", "webp")
    w = F.coalesce(width, F.when(moving_picture, WIDTH[2]).otherwise(WIDTH[3]))
    f = F.coalesce(fps, F.when(moving_picture, FPS[2]).otherwise(FPS[3]))
    held = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x)).cast("int")
    return F.struct(
        held(w, WIDTH[0], WIDTH[1]).alias("width"), held(f, FPS[0], FPS[1]).alias("fps"), (~moving_picture & ~kind.isin("png", "jpg")).alias("sound")
    )


def render_plan(clips: DataFrame) -> DataFrame:
    """Segments of each cut in order, clips without a match left out, with the progress after each.

    ``clips(cut_id, pos, start_ms, end_ms)``; encoding takes the first 85 of 100.
    """
    order = Window.partitionBy("cut_id").orderBy("pos")
    kept = clips.where("start_ms is not null and end_ms is not null")
    n = F.count("*").over(Window.partitionBy("cut_id"))
    return kept.select("cut_id", "pos", "start_ms", "end_ms", (F.row_number().over(order) - 1).alias("segment"), n.alias("n")).select(
        "cut_id", "pos", "segment", "start_ms", "end_ms", F.round((F.col("segment") + 1) / F.col("n") * 0.85, 6).alias("progress")
    )


# What an encoder's reports say, in the order in which they are looked for, and what it means.
FAILURES = (
    ("unauthorised", r"(?i)401 Unauthorized", "The server rejected the request while the video was read (401); the key may have been revoked."),
    ("late", r"(?i)Operation timed out|Connection timed out|timed out", "The server took too long to start the clip; it may be busy, try again."),
    ("gone", r"(?i)40[34] (?:Not Found|Forbidden)", "The server could not serve the video (404); it may have been removed or moved since it was indexed."),
    ("unreachable", r"(?i)Connection refused|Failed to resolve hostname|Network is unreachable", "The server could not be reached while the video was read."),
    ("file_missing", r"(?i)No such file or directory", "A temporary file of the export went missing; try again."),
    ("no_font", r"(?i)Fontconfig|Cannot load font|no usable font", "No font was found to draw captions with; install one or name one."),
)
#: What an encoder says of a credential in an address.
CREDENTIAL = r"(?i)((?:api_key|apikey|api-key|X-Emby-Token)=)[^&\s\"']+"
CRASH = "SIGSEGV"


def without_credentials(report: Column) -> Column:
    return F.regexp_replace(F.coalesce(report, F.lit("")), CREDENTIAL, "$1REDACTED")


def failure_class(report: Column, signal: Column) -> Column:
    """``crash`` or ``killed`` where a signal ended the encoder, else the first of :data:`FAILURES` that its report shows, else ``other``; null without either."""
    told = F.when(signal == CRASH, "crash").when(signal != "", "killed")
    for name, pattern, _ in FAILURES:
        told = told.when(F.coalesce(report, F.lit("")).rlike(pattern), name)
    return told.when(T.trimmed(F.coalesce(report, F.lit(""))) != "", "other")


def explain_failure(report: Column, signal: Column | None = None) -> Column:
    """What went wrong in words; where no class fits, the last six lines of the report that aren't blank, without credentials."""
    signal = F.lit(None).cast("string") if signal is None else signal
    lines = F.filter(F.split(without_credentials(report), "\r?\n"), lambda x: T.trimmed(x) != "")
    tail = F.array_join(F.when(F.size(lines) > 6, F.slice(lines, -6, 6)).otherwise(lines), "\n")
    kind = failure_class(report, signal)
    told = F.when(kind == "crash", "The encoder crashed without reading anything; one that is linked statically can't resolve names.")
    told = told.when(kind == "killed", F.concat(F.lit("The encoder was killed by "), signal, F.lit(" before it finished.")))
    for name, _, words in FAILURES:
        told = told.when(kind == name, words)
    return told.otherwise(tail)
