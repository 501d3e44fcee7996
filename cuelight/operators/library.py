"""Catalogue, read models and maintenance of the library."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Identifiers of a title in other catalogues, in their order of trust.
PROVIDERS = ("Tvdb", "Tmdb", "Imdb")


def collapse_titles(items: DataFrame) -> DataFrame:
    """One title for each kind and provider id, that with the least id; titles without any all stay."""
    key = F.coalesce(*[F.when(F.col("provider_ids")[p] != "", F.concat(F.lit(p + ":"), F.col("provider_ids")[p])) for p in PROVIDERS])
    order = Window.partitionBy("kind", "key").orderBy("id")
    ranked = items.withColumn("key", key).withColumn("n", F.row_number().over(order))
    return ranked.where("key is null or n = 1").drop("key", "n")


def pick_subtitle(streams: Column) -> Column:
    """The best text track in English or without a language; the first of equals; null for none.

    English counts most, then not forced, then not for the hard of hearing, then default.
    """
    english = lambda s: F.coalesce(F.lower(s["language"]).startswith("en"), F.lit(False))
    untagged = lambda s: F.coalesce(F.lower(s["language"]).isin("", "und"), F.lit(True))
    fit = F.filter(streams, lambda s: (s["type"] == "Subtitle") & s["is_text"] & (english(s) | untagged(s)))
    flag = lambda c, n: F.when(c, n).otherwise(0)
    scored = F.transform(
        fit,
        lambda s, k: F.struct(
            (-(flag(english(s), 8) + flag(~s["is_forced"], 4) + flag(~s["is_sdh"], 2) + flag(s["is_default"], 1))).alias("cost"),
            k.alias("at"),
            s["index"].alias("index"),
        ),
    )
    return F.array_min(scored)["index"]


def pick_audio(streams: Column) -> Column:
    """The first English audio track; null for none."""
    return F.get(F.filter(streams, lambda s: (s["type"] == "Audio") & F.coalesce(F.lower(s["language"]).startswith("en"), F.lit(False))), 0)["index"]


def ticks_to_ms(ticks: Column) -> Column:
    return F.floor(ticks / 10_000 + 0.5)


def title_counts(titles: DataFrame, videos: DataFrame, lines: DataFrame) -> DataFrame:
    """Titles with the number of their indexed videos and of their lines."""
    v = videos.groupBy("title_id").agg(F.count_if(F.col("subtitle_status") == "ok").alias("video_count"))
    n = lines.groupBy("title_id").agg(F.count("*").alias("line_count"))
    return (
        titles.join(v, titles["id"] == v["title_id"], "left")
        .drop("title_id")
        .join(n, titles["id"] == n["title_id"], "left")
        .drop("title_id")
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("video_count", "line_count")})
    )


def missing_subtitles(titles: DataFrame, videos: DataFrame) -> DataFrame:
    """Titles with the number of their videos without lines, by name."""
    bad = videos.where(F.col("subtitle_status").isin("none", "error")).groupBy("title_id").agg(F.count("*").alias("missing"))
    joined = titles.join(bad, titles["id"] == bad["title_id"], "left").drop("title_id")
    return joined.withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long")).orderBy(F.lower("name"), "id")


def upsert(old: DataFrame, new: DataFrame, key: str, changed: list[str]) -> DataFrame:
    """``old`` with the rows of ``new``: known keys take its ``changed`` columns, others come whole."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"n.{key}").isNotNull()
    pick = {
        c: F.coalesce(f"o.{c}", f"n.{c}") if c == key else F.when(there & (F.lit(c in changed) | F.col(f"o.{key}").isNull()), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        for c in old.columns
    }
    return both.select(*[v.alias(c) for c, v in pick.items()])


def replace_by(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of ``touched`` keys, and ``new``: a key whose new rows are none loses its old ones."""
    return old.join(touched.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows whose title is in ``gone(title_id)``; tables come with their title column."""
    ids = gone.select("title_id").distinct()
    return {name: df.join(ids, df[column] == ids["title_id"], "left_anti") for name, (df, column) in tables.items()}


def removal_cost(gone: DataFrame, montages: DataFrame, renders: DataFrame) -> DataFrame:
    """Cuts and finished renders that go with each title."""
    m = montages.join(gone.select("title_id").distinct(), "title_id", "left_semi")
    done = renders.where("status = 'done'").groupBy("montage_id").agg(F.count("*").alias("n"))
    return m.join(done, m["id"] == done["montage_id"], "left").groupBy("title_id").agg(
        F.count("*").alias("montages"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("renders")
    )


#: Bytes that a cache may hold where nothing is set, and the stretches of time that are summed in a task each.
CACHE_CAP, STRETCHES = 2 << 30, 256
# Fixed value: endings of files that are still being written.
PARTIAL = r"\.(part|tmp|partial)\z"


def cache_cap(setting: str | None) -> int:
    """A cap as set, in bytes; blank, negative or no number is the default."""
    text = (setting or "").strip()
    return int(text) if text.isascii() and text.isdigit() else CACHE_CAP


def eviction_plan(files: DataFrame, cap: int = CACHE_CAP, by: str = "shelf", busy: DataFrame | None = None) -> DataFrame:
    """Files to delete, oldest first, until each ``by`` is at most ``cap`` bytes.

    A file goes while those before it that went are less than what is over. Files
    that are partial, or in flight by ``busy(path)``, count but stay. Sums run in
    two levels, over stretches of time and in each, so a shelf isn't one task.
    Stretches lie between quantiles of the times, so each has about as many files; those of
    one time are in one.
    """
    free = ~F.col("path").rlike(PARTIAL)
    rows = files
    if busy is not None:
        rows = rows.join(busy.select("path", F.lit(True).alias("in_flight")).distinct(), "path", "left")
        free = free & F.col("in_flight").isNull()
    edges = sorted(set(files.approxQuantile("mtime_ms", [k / STRETCHES for k in range(1, STRETCHES)], 0.25 / STRETCHES)))
    rows = rows.withColumn("free", F.when(free, F.col("size")).otherwise(0)).withColumn("__time", F.col("mtime_ms").cast("double"))
    deal = Bucketizer(splits=[float("-inf"), *(edges or [0.0]), float("inf")], inputCol="__time", outputCol="stretch", handleInvalid="keep")
    rows = deal.transform(rows).drop("__time")
    earlier = Window.partitionBy(by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(by, "stretch").agg(F.sum("free").alias("free_sum"), F.sum("size").alias("size_sum"))
    bases = sums.select(
        by, "stretch", F.coalesce(F.sum("free_sum").over(earlier), F.lit(0)).alias("base"), (F.sum("size_sum").over(Window.partitionBy(by)) - cap).alias("excess")
    )
    before = Window.partitionBy(by, "stretch").orderBy("mtime_ms", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("gone", F.coalesce(F.sum("free").over(before), F.lit(0))).join(bases, [by, "stretch"])
    return placed.where(free & (F.col("gone") + F.col("base") < F.col("excess"))).select(*files.columns)


# ---- read models --------------------------------------------------------------


def annotate_remote(remote: DataFrame, local: DataFrame, key: str = "id") -> DataFrame:
    """Titles of a server with what the library has of them: ``indexed``, and ``line_count`` or 0.

    ``local(key, indexed_at, line_count)``; a title is indexed once it has a time.
    """
    known = local.select(key, "indexed_at", F.col("line_count").alias("__lines"))
    return remote.join(known, key, "left").select(*remote.columns, F.col("indexed_at").isNotNull().alias("indexed"), F.coalesce("__lines", F.lit(0)).alias("line_count"))


def ordered_videos(videos: DataFrame, by: str = "title_id") -> DataFrame:
    """Videos with their ``place`` in their title: by season and number, those without first, then by name and id."""
    order = Window.partitionBy(by).orderBy(F.asc_nulls_first("season"), F.asc_nulls_first("episode"), "name", "video_id")
    return videos.withColumn("place", F.row_number().over(order))


def indexed_videos(asked: DataFrame, videos: DataFrame) -> DataFrame:
    """The videos asked for that the library has lines of; others are not to be served."""
    return videos.where("subtitle_status = 'ok'").join(asked.select("video_id").distinct(), "video_id", "left_semi")


def montage_summaries(cuts: DataFrame, titles: DataFrame) -> DataFrame:
    """Cuts with their title's name, or that it is unknown, and the number of their ``clips``."""
    named = titles.select("title_id", F.col("name").alias("title"))
    return cuts.join(named, "title_id", "left").withColumn("title", F.coalesce("title", F.lit("Unknown"))).withColumn("n_clips", F.size("clips").cast("long"))


def holding(titles: DataFrame, word: str, name: str = "name") -> DataFrame:
    """Titles whose name holds ``word``, whatever its case."""
    return titles.where(F.contains(F.lower(name), F.lit(word.lower())))


def facet_counts(titles: DataFrame, facet: Column) -> DataFrame:
    """Titles of each facet, and how many of them have lines to search."""
    return titles.groupBy(facet.alias("facet")).agg(F.count("*").alias("n"), F.count_if(F.col("line_count") > 0).alias("searchable"))


def ordered_picks(picks: Column) -> Column:
    """Picked places, each once, in ascending order."""
    return F.array_sort(F.array_distinct(picks))


def missing_ids(asked: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Ids asked for, each once, that aren't found."""
    return asked.select(key).distinct().join(found.select(key), key, "left_anti")


def latest(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last row of each ``by``: a maximum that combines before the shuffle."""
    rest = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(by, "r.*")


def apply_patches(rows: DataFrame, log: DataFrame, key: str, columns: list[str], order: str = "at") -> DataFrame:
    """Rows with the last value that the log gives for each column; what no patch sets stays, and ``updated_at`` is the last patch's."""
    last = log.groupBy(key).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in columns], F.max(order).alias("__at"))
    old = F.col("updated_at") if "updated_at" in rows.columns else F.lit(None)
    kept = [F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns if c != "updated_at"]
    return rows.join(last, key, "left").select(*kept, F.coalesce("__at", old).alias("updated_at"))


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Rows with the columns that newer versions added, at their defaults where they are missing."""
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def remaining(items: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Items of which no ``done(key)`` is known; all of them if forced."""
    return items if force else items.join(done.select(key), key, "left_anti")
