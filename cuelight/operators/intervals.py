"""Joins of marks to the intervals and points of their video that lie near them.

Nothing here gathers a whole video. Intervals and marks meet in stretches of time: an
interval lies in the stretches of its own length class, doubled from class to class,
so it is in two of them whatever its length, and a mark looks into those that it
touches in every class that occurs. Points on either side of a mark come from its
own stretch, or else from the next stretch that has any, which is carried over
rows of stretches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of the shortest class of stretches.
STRETCH_MS = 60_000


def _stretch(at: Column, size: Column) -> Column:
    return F.floor(at / size)


def near_intervals(marks: DataFrame, intervals: DataFrame, key: list[str], by: str = "video_id", stretch_ms: int = STRETCH_MS) -> DataFrame:
    """Pairs of ``marks(key, by, lo, hi)`` and ``intervals(by, start_ms, end_ms, …)`` that touch; marks that touch none stay, with nulls.

    ``key`` tells the marks of a ``by`` apart. Each pair is found once. An interval
    with its ends swapped is taken for what lies between them; one without an end
    touches nothing.
    """
    start, end = F.least("start_ms", "end_ms"), F.greatest("start_ms", "end_ms")
    kept = intervals.where("start_ms is not null and end_ms is not null")
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1), end - start) / stretch_ms))).cast("int")
    size = lambda of: stretch_ms * F.pow(F.lit(2.0), of)
    spread = kept.withColumn("__level", level).withColumn("__since", _stretch(start, size(F.col("__level"))))
    spread = spread.withColumn("__place", F.explode(F.sequence("__since", _stretch(end, size(F.col("__level"))))))
    levels = [r[0] for r in kept.select(level.alias("level")).distinct().collect()]  # at most 63
    if not levels:
        levels = [0]
    asked = marks.withColumn("__in", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]))).withColumn("__from", _stretch(F.col("lo"), size(F.col("__in"))))
    asked = asked.withColumn("__at", F.explode_outer(F.when(F.col("lo") <= F.col("hi"), F.sequence("__from", _stretch(F.col("hi"), size(F.col("__in")))))))
    a, b = asked.alias("a"), spread.alias("b")
    touches = (F.least("b.start_ms", "b.end_ms") <= F.col("a.hi")) & (F.greatest("b.start_ms", "b.end_ms") >= F.col("a.lo"))
    once = F.col("__place") == F.greatest("__from", "__since")
    same = (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("__in") == F.col("__level")) & (F.col("__at") == F.col("__place"))
    met = a.join(b, same & touches & once, "left")
    own = [F.col(f"a.{c}") for c in marks.columns]
    return met.select(*own, *[F.col(f"b.{c}") for c in intervals.columns if c != by])


def with_near(marks: DataFrame, intervals: DataFrame, key: list[str], name: str, by: str = "video_id", stretch_ms: int = STRETCH_MS) -> DataFrame:
    """``marks`` with the intervals that touch ``lo`` to ``hi``, as the array ``name`` in order of start, end and the rest.

    An array is as long as its mark's span holds intervals, and not as its video.
    """
    fields = [c for c in intervals.columns if c != by]
    order = ["start_ms", "end_ms"] + [c for c in fields if c not in ("start_ms", "end_ms")]
    clash = set(fields) & set(marks.columns)
    intervals = intervals.select(by, *[F.col(c).alias(c if c in ("start_ms", "end_ms") else f"__{c}") for c in order])
    marks = marks.select(*[F.col(c).alias(f"__mark_{c}") if c in clash else F.col(c) for c in marks.columns])
    keys = [f"__mark_{k}" if k in clash else k for k in key]
    pairs = near_intervals(marks, intervals, keys, by, stretch_ms)
    one = F.when(F.col("start_ms").isNotNull(), F.struct(*[F.col(c if c in ("start_ms", "end_ms") else f"__{c}").alias(c) for c in order]))
    rest = [c for c in marks.columns if c not in (by, *keys)]
    found = pairs.groupBy(by, *keys).agg(*[F.first(c).alias(c) for c in rest], F.array_sort(F.collect_list(one)).alias(name))
    return found.select(*[F.col(c).alias(c.removeprefix("__mark_")) for c in marks.columns], name)


def first_past(marks: DataFrame, points: DataFrame, key: list[str], at: str, name: str, by: str = "video_id", stretch_ms: int = STRETCH_MS, before: bool = False) -> DataFrame:
    """``marks`` with the least ``p`` of ``points(by, p)`` over the column ``at``, or with ``before`` the greatest under it; null for none."""
    if before:
        turned = first_past(marks.withColumn(at, -F.col(at)), points.select(by, (-F.col("p")).alias("p")), key, at, name, by, stretch_ms)
        return turned.withColumn(at, -F.col(at)).withColumn(name, -F.col(name))
    size = F.lit(stretch_ms)
    dots = points.where("p is not null").select(by, "p", _stretch(F.col("p"), size).alias("__place"))
    asked = marks.withColumn("__place", _stretch(F.col(at), size))
    least = dots.groupBy(by, "__place").agg(F.min("p").alias("__least"))
    places = least.unionByName(asked.select(by, "__place", F.lit(None).cast(dict(points.dtypes)["p"]).alias("__least"))).groupBy(by, "__place").agg(F.min("__least").alias("__least"))
    # a row for each stretch of a video that has a point or a mark
    later = Window.partitionBy(by).orderBy(F.desc("__place")).rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("__next", F.last("__least", ignorenulls=True).over(later)).select(by, "__place", "__next")
    inside = asked.select(by, *key, at, "__place").join(dots, [by, "__place"]).where(F.col("p") > F.col(at)).groupBy(by, *key).agg(F.min("p").alias("__inside"))
    found = asked.join(carried, [by, "__place"], "left").join(inside, [by, *key], "left")
    return found.select(*marks.columns, F.coalesce("__inside", "__next").alias(name))
