"""Quality rules: base rules, and robust multivariate outliers by language and source.

Each text gives a vector of transformed statistics. For every group of language
and source, the minimum covariance determinant estimate finds the center and
scatter of the most concentrated share of its documents, and a document far from
them by Mahalanobis distance is rejected. The estimates follow Rousseeuw and Van
Driessen (1999), from the fixed starts of Hubert, Rousseeuw and Verdonck (2012):

1. Offsets from the group's median are scaled by their median deviation in the
   language, and by ``sqrt(n / (n + NOISE_WORDS))``, as the statistics of a text of
   few words n scatter with the draw of its words. So wider groups have the
   scatter within sources, not that between them.
2. Three starts a group, about its median: unit scatter, the covariance of the
   offsets' signs in space, and that of their hyperbolic tangents.
3. Concentration steps for all starts at once; of each group the start with the
   least determinant goes on with more steps.
4. The scatter is made consistent for normal data, and estimated once more over
   all documents within the 0.975 quantile.
5. An estimate shrinks towards that of its language, and a language's towards
   that of all documents, by ``PRIOR`` documents: a group of any size has one.

Texts of a group are mixtures (quotations, addresses, lists, other languages), so
distances have longer tails than those of normal data. The cutoff is the quantile
of the multivariate t distribution of ``FREEDOM`` degrees of freedom; with many
degrees it would be that of the chi-square distribution.

The steps run over all rows and never gather a group. One step bins the distances
of all rows finely and sums moments by group, start and bin (combined before the
shuffle); the bins that hold the nearest share give the next center and scatter,
the last bin in part. Only the estimates, a few rows a group, pass from one step
to the next. Documents of equal statistics count once in a group, so copies don't
make a group look tighter than it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.common import small_text_batches, stable, text_of

BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_letters", "n_upper", "n_distinct")
BLANK = re.compile(r"[\x20\x09-\x0D]+")
BEYOND_ASCII = re.compile("[^\x00-\x7f]")
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LETTERS = UPPER + UPPER.lower()

#: Statistics of a vector.
D = 4
#: Share of a group that the estimate concentrates on; steps of all starts, and of the best one.
SHARE, FIRST_STEPS, STEPS = 0.75, 2, 4
STARTS = 3
#: Words at which the draw of a text's words scatters its statistics as much as texts differ anyway.
NOISE_WORDS = 200
#: Documents that the estimate of the wider group weighs as much as: two for each of its numbers.
PRIOR = 2 * (D + D * (D + 1) // 2)
#: Degrees of freedom of the tails of a group, and the probability that one of its documents is rejected.
FREEDOM, TAIL = 4, 1e-3
#: Variance added to every direction, in units of the language's: keeps constant statistics invertible.
RIDGE = 1e-3
#: Estimates of up to so many groups are broadcast (under 10 MB); more are joined by a shuffle.
BROADCAST_GROUPS = 20_000
#: Widths of the bins of the medians of statistics and of scaled ones, far below their scatter.
BIN, SCALED_BIN = 0.0005, 0.01


def repeated(words: list[str], size: int = 5) -> int:
    """Words in windows of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    window, kinds, span = ids[:n], len(codes), len(codes)
    for k in range(1, size):
        if span * kinds >= 1 << 62:  # number the windows so far anew
            _, window = np.unique(window, return_inverse=True)
            span = int(window.max()) + 1
        window, span = window * kinds + ids[k : k + n], span * kinds
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = np.zeros(n + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    at = order[same[:-1] | same[1:]]
    if not len(at):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    cover[at] += 1
    cover[at + size] -= 1
    return int((np.cumsum(cover)[:-1] > 0).sum())


def _number(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def statistics(text: str) -> tuple[int, ...]:
    """``n_words``, the base and the extra counts of one text; letters are those of Unicode."""
    words = [w for w in BLANK.split(text) if w]
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")] if words else []
    raw = text.encode("utf-8")
    wide = Counter() if text.isascii() else Counter(BEYOND_ASCII.findall(text))
    return (
        len(words),
        sum(map(len, words)),
        _number(raw, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated(words),
        _number(raw, LETTERS) + sum(n for c, n in wide.items() if c.isalpha()),
        _number(raw, UPPER) + sum(n for c, n in wide.items() if c.isupper()),
        len(set(words)),
    )


def _vector() -> Column:
    """Shares of other characters than letters and of capitals (as roots), log word length, and Herdan's C."""
    n = F.greatest("n_words", F.lit(1))
    others = F.greatest(F.col("word_chars") - F.col("n_letters"), F.lit(0))
    return F.array(
        F.sqrt(others / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_upper") / F.greatest("n_letters", F.lit(1))),
        F.log(F.greatest("word_chars", F.lit(1)) / n),
        F.log(F.greatest("n_distinct", F.lit(1))) / F.log(n + 1.0),
    )


def _group(*parts: str) -> Column:
    """The key of a group of some language and source, of some language, or of all; nulls are values."""
    return F.to_json(F.array(F.lit(str(len(parts))), *[F.col(c) for c in parts]))


def measured(docs: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    small_text_batches(docs.sparkSession)
    names = ("n_words", *BASE, *EXTRA)

    @F.pandas_udf(", ".join(f"{c} long" for c in names))
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame(list(map(statistics, batch)), columns=names)

    return (
        docs.select(
            F.col(key).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), measure(text_of(text)).alias("m")
        )
        .select("doc_id", "m.*", _group("lang").alias("lang_group"), _group("lang", "source").alias("own_group"))
        .select(
            "doc_id",
            "n_words",
            *BASE,
            "lang_group",
            "own_group",
            ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
            _vector().alias("x"),
        )
    )


# ---- chi-square ---------------------------------------------------------------


def chi2_cdf(x: float, k: int) -> float:
    """Probability that a chi-square variable of ``k`` degrees of freedom is at most ``x``."""
    a, p = (0.5, math.erf(math.sqrt(x / 2))) if k % 2 else (1.0, -math.expm1(-x / 2))
    while a < k / 2:
        p -= (x / 2) ** a * math.exp(-x / 2) / math.gamma(a + 1)
        a += 1
    return p


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return high


def t_cutoff(tail: float, k: int, freedom: float) -> float:
    """Distance over which a point of a ``k``-dimensional t distribution lies with probability ``tail``; ``k`` is even."""
    b = freedom / 2

    def beyond(x: float) -> float:
        return (1 - x) ** b * sum(math.gamma(b + j) / math.gamma(b) / math.factorial(j) * x**j for j in range(k // 2))

    low, high = 0.0, 1.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle) > tail else (low, middle)
    return math.sqrt(freedom * high / (1 - high))


def consistency(share: float, k: int) -> float:
    """What the scatter of the nearest ``share`` of normal data is short of, as a factor."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


# ---- estimates ----------------------------------------------------------------


def _side(estimates: DataFrame, groups: int) -> DataFrame:
    return F.broadcast(estimates) if groups <= BROADCAST_GROUPS else estimates


def _medians(values: DataFrame, width: float) -> DataFrame:
    """``group, n, middle`` of ``values(group, dim, v)``: medians of each dimension, to a bin's width.

    What is shuffled are counts by group, dimension and bin, never one group's state.
    """
    bins = values.groupBy("group", "dim", F.floor(F.col("v") / width).alias("bin")).agg(F.count("*").alias("c"))
    one = Window.partitionBy("group", "dim")
    upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    half = bins.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(one)).where(F.col("upto") * 2 >= F.col("n"))
    middle = half.groupBy("group", "dim").agg(F.first("n").alias("n"), ((F.min("bin") + 0.5) * width).alias("middle"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "middle")))  # a row a dimension
    return middle.groupBy("group").agg(F.first("n").alias("n"), F.transform(ordered, lambda m: m["middle"]).alias("middle"))


def _shrunk(own: Column, n: Column, wider: Column) -> Column:
    """Arrays between a group's own and the wider group's, by the documents behind the own one."""
    return F.zip_with(F.coalesce(own, wider), wider, lambda a, b: (n * a + PRIOR * b) / (n + PRIOR))


def scales(points: DataFrame) -> DataFrame:
    """``own_group, middle, deviation`` of ``points(lang_group, own_group, n_words, x)``.

    ``middle`` is the group's median, shrunk towards the language's and that of
    all; ``deviation`` the language's median deviation from its groups' medians,
    shrunk towards that of all. A deviation of zero, of a statistic constant in
    half of the documents, is that of all languages, or one.
    """
    levels = points.select(F.explode(F.array("own_group", "lang_group", _group())).alias("group"), F.posexplode("x").alias("dim", "v"))
    medians = stable(_medians(levels, BIN))
    groups = medians.count()
    keys = stable(points.select("own_group", "lang_group").distinct())
    named = lambda df, k: df.select(F.col("group").alias(f"g{k}"), F.col("n").alias(f"n{k}"), F.col("middle").alias(f"m{k}"))

    def of_language(df: DataFrame, told: DataFrame) -> DataFrame:
        told = told.join(named(df, 1), F.col("lang_group") == F.col("g1"))
        return told.crossJoin(F.broadcast(named(df, 0).where(F.col("g0") == _group())))  # one row

    told = of_language(medians, keys.join(named(medians, 2), F.col("own_group") == F.col("g2")))
    of_lang = _shrunk(F.col("m1"), F.col("n1"), F.col("m0"))
    middles = stable(told.select("own_group", "lang_group", _shrunk(F.col("m2"), F.col("n2"), of_lang).alias("middle")))
    off = F.transform(F.zip_with("x", "middle", lambda a, b: F.abs(a - b)), lambda v: v * _few())
    spread = points.join(_side(middles.drop("lang_group"), groups), "own_group").select(
        F.explode(F.array("lang_group", _group())).alias("group"), F.posexplode(off).alias("dim", "v")
    )
    told = of_language(stable(_medians(spread, BIN)), middles)
    positive = lambda a: F.transform(a, lambda v: F.when(v > BIN, v))
    of_all = F.transform(positive(F.col("m0")), lambda v: F.coalesce(v, F.lit(1.0)))
    own = F.zip_with(positive(F.col("m1")), of_all, lambda a, b: F.coalesce(a, b))
    return told.select("own_group", "middle", F.transform(_shrunk(own, F.col("n1"), of_all), lambda v: v * 1.4826).alias("deviation"))


def _few() -> Column:
    return F.sqrt(F.col("n_words") / (F.col("n_words") + F.lit(float(NOISE_WORDS))))


def _scaled() -> Column:
    """``x`` of ``n_words`` words about ``middle`` in units of ``deviation``."""
    return F.transform(F.zip_with("x", "middle", lambda a, b: a - b), lambda v, i: v / F.get("deviation", i) * _few())


def _squared(z: str, center: Column, inverse: Column) -> Column:
    """Squared distance of ``z`` from ``center`` by the inverse scatter ``inverse``."""
    off = [F.get(z, i) - F.get(center, i) for i in range(D)]
    total = F.lit(0.0)
    for i in range(D):
        for j in range(i, D):
            total = total + off[i] * off[j] * F.get(inverse, i * D + j) * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
MOMENTS = ["c", *[f"s{i}" for i in range(D)], *[f"q{i}_{j}" for i, j in PAIRS]]


def _moments(z: str) -> list[Column]:
    """Sums of ``z`` and of its products, named as ``MOMENTS`` are."""
    return [
        F.count("*").alias("c"),
        *[F.sum(F.get(z, i)).alias(f"s{i}") for i in range(D)],
        *[F.sum(F.get(z, i) * F.get(z, j)).alias(f"q{i}_{j}") for i, j in PAIRS],
    ]


def _estimate(factor: float = 1.0) -> tuple[Column, Column]:
    """Center and scatter (row by row) from the sums of a row."""
    mean = [F.col(f"s{i}") / F.col("c") for i in range(D)]
    cov = lambda i, j: (F.col(f"q{i}_{j}") / F.col("c") - mean[i] * mean[j]) * factor
    return F.array(*mean), F.array(*[cov(min(i, j), max(i, j)) for i in range(D) for j in range(D)])


def _inverted(estimates: DataFrame, scatter: str = "scatter") -> DataFrame:
    """With ``inverse`` and ``logdet`` of the scatter; a row is a group's, or that of one of its starts."""

    @F.pandas_udf("inverse array<double>, logdet double")
    def invert(moments: pd.Series) -> pd.DataFrame:
        whole = np.array([np.reshape(m, (D, D)) for m in moments]).reshape(-1, D, D) + RIDGE * np.eye(D)
        return pd.DataFrame({"inverse": list(np.linalg.inv(whole).reshape(-1, D * D)), "logdet": np.linalg.slogdet(whole)[1]})

    return estimates.withColumn("i", invert(scatter)).select(*estimates.columns, "i.inverse", "i.logdet")


def _starts(vectors: DataFrame, medians: DataFrame, groups: int) -> DataFrame:
    """``group, start, n, center, scatter``: three starts a group about its median."""
    off = vectors.join(_side(medians, groups), "group").select("group", F.zip_with("z", "middle", lambda a, b: a - b).alias("o"))
    length = F.greatest(F.sqrt(F.aggregate("o", F.lit(0.0), lambda s, v: s + v * v)), F.lit(1e-9))
    sums = off.select("group", F.transform("o", lambda v: v / length).alias("sign"), F.transform("o", F.tanh).alias("bent")).groupBy("group")
    of = lambda z, k: [F.sum(F.get(z, i) * F.get(z, j)).alias(f"{k}{i}_{j}") for i, j in PAIRS]
    told = medians.join(sums.agg(*of("sign", "a"), *of("bent", "b")), "group")
    full = lambda k, times: F.array(*[F.col(f"{k}{min(i, j)}_{max(i, j)}") / F.col("n") * times for i in range(D) for j in range(D)])
    unit = F.array(*[F.lit(float(i == j)) for i in range(D) for j in range(D)])
    return told.select(
        "group", "n", F.col("middle").alias("center"), F.posexplode(F.array(unit, full("a", float(D)), full("b", 1.0))).alias("start", "scatter")
    )


def _concentrated(vectors: DataFrame, estimates: DataFrame, share: float, groups: int) -> DataFrame:
    """One concentration step for every start of every group: ``group, start, n, center, scatter``."""
    told = estimates.groupBy("group").agg(F.first("n").alias("n"), F.collect_list(F.struct("start", "center", "inverse")).alias("e"))  # at most STARTS
    near = vectors.join(_side(told, groups), "group").select("group", "n", "z", F.explode("e").alias("e"))
    binned = near.select("group", "n", "z", "e.start", F.floor(F.log(_squared("z", F.col("e.center"), F.col("e.inverse")) + 1e-6) * 16).alias("bin"))
    bins = binned.groupBy("group", "start", "bin").agg(F.first("n").alias("n"), *_moments("z"))  # a row for each step of the distance
    before = Window.partitionBy("group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # half of a group and one more at least
    wanted = F.greatest(F.ceil(F.col("n") * share), F.floor((F.col("n") + D + 1) / 2))
    part = F.least(F.lit(1.0), (wanted - F.coalesce(F.sum("c").over(before), F.lit(0))) / F.col("c"))
    inner = bins.withColumn("part", part).where("part > 0")
    sums = inner.groupBy("group", "start").agg(F.first("n").alias("n"), *[F.sum(F.col(k) * F.col("part")).alias(k) for k in MOMENTS])
    center, scatter = _estimate()
    return sums.select("group", "start", "n", center.alias("center"), scatter.alias("scatter"))


def concentrate(vectors: DataFrame, share: float = SHARE, first_steps: int = FIRST_STEPS, steps: int = STEPS) -> DataFrame:
    """``group, n, center, scatter`` for each group of ``vectors(group, z)``: reweighted minimum covariance determinant."""
    medians = stable(_medians(vectors.select("group", F.posexplode("z").alias("dim", "v")), SCALED_BIN))
    groups = medians.count()
    estimates = stable(_inverted(_starts(vectors, medians, groups)))
    for _ in range(first_steps):
        estimates = stable(_inverted(_concentrated(vectors, estimates, share, groups)))
    best = Window.partitionBy("group").orderBy("logdet", "start")
    estimates = stable(estimates.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place"))
    for _ in range(steps):
        estimates = stable(_inverted(_concentrated(vectors, estimates, share, groups)))
    wide = F.lit(consistency(share, D))
    estimates = stable(_inverted(estimates.select("group", "n", "center", F.transform("scatter", lambda v: v * wide).alias("scatter"))))
    keep = 0.975
    near = vectors.join(_side(estimates, groups), "group").where(_squared("z", F.col("center"), F.col("inverse")) <= chi2_quantile(keep, D))
    sums = near.groupBy("group").agg(F.first("n").alias("n"), *_moments("z"))
    center, scatter = _estimate(consistency(keep, D))
    again = sums.select("group", center.alias("new_center"), scatter.alias("new_scatter"))
    return estimates.join(again, "group", "left").select(
        "group", "n", F.coalesce("new_center", "center").alias("center"), F.coalesce("new_scatter", "scatter").alias("scatter")
    )


def estimates_of(points: DataFrame, share: float = SHARE) -> DataFrame:
    """``own_group, center, inverse`` for each group of ``points(lang_group, own_group, z)``, shrunk towards wider groups."""
    vectors = points.select(F.explode(F.array("own_group", "lang_group", _group())).alias("group"), "z")
    found = stable(concentrate(vectors, share))
    keys = stable(points.select("own_group", "lang_group").distinct())
    named = lambda k: found.select(F.col("group").alias(f"g{k}"), F.col("n").alias(f"n{k}"), F.col("center").alias(f"c{k}"), F.col("scatter").alias(f"s{k}"))
    told = keys.join(named(2), F.col("own_group") == F.col("g2")).join(named(1), F.col("lang_group") == F.col("g1"))
    told = told.crossJoin(F.broadcast(named(0).where(F.col("g0") == _group())))  # one row
    for k in "cs":
        told = told.withColumn(k, _shrunk(F.col(f"{k}2"), F.col("n2"), _shrunk(F.col(f"{k}1"), F.col("n1"), F.col(f"{k}0"))))
    return _inverted(told.select("own_group", F.col("c").alias("center"), F.col("s").alias("scatter"))).select("own_group", "center", "inverse")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tail: float = TAIL, freedom: float = FREEDOM) -> DataFrame:
    """Base counts, ``base_failed``, ``kept`` and ``distance`` for every row.

    A null text has no words and fails the base rules. Null languages and
    sources are values of their own. Documents that fail the base rules are not
    part of the estimates, and their distance is null. A group of few documents
    is judged mostly by its language's estimate, one of a single language mostly
    by that of all; without a sound document nothing is estimated. Repeated rows
    give repeated rows, an empty table an empty result; other columns are not
    read.
    """
    rows = stable(measured(docs, key, text, lang, source))
    sound = rows.where("not base_failed")
    # equal statistics of a group count once
    points = stable(sound.select("lang_group", "own_group", "n_words", "x").distinct())
    scale = stable(scales(points))
    groups = scale.count()
    scaled = stable(points.join(_side(scale, groups), "own_group").select("lang_group", "own_group", _scaled().alias("z")))
    estimates = stable(estimates_of(scaled).join(scale, "own_group"))
    columns = ["doc_id", "n_words", *BASE, "base_failed"]
    judged = (
        sound.join(_side(estimates, groups), "own_group")
        .withColumn("z", _scaled())
        .select(*columns, F.sqrt(_squared("z", F.col("center"), F.col("inverse"))).alias("distance"))
    )
    failed = rows.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"))
    cutoff = t_cutoff(tail, D, freedom)
    return judged.unionByName(failed).select(*columns, F.coalesce(F.col("distance") <= cutoff, F.lit(False)).alias("kept"), "distance")


def keep_sound(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that are kept, with all columns; a key is kept if one of its rows is."""
    kept = judge(docs, key).where("kept").select(F.col("doc_id").alias("__kept"))
    return docs.join(kept, docs[key].eqNullSafe(kept["__kept"]), "left_semi")
