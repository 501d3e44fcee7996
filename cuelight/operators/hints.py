"""What a description says about where to look: an episode, a season, a position.

A description that comes with a title is read against that title's episodes
alone, one without against all of them. Episodes are therefore entered in an
index by scope, once for their title and once for the whole library, and every
lookup is by scope and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions import text as T


def _label(name: str = "name", season: str = "season", episode: str = "episode"):
    both = F.col(season).isNotNull() & F.col(episode).isNotNull()
    return F.when(both, F.format_string("%s (S%dE%d)", name, season, episode)).otherwise(F.col(name))


def _first(found: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _by_scope(queries: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with their ``scope``: the ``title_id`` behind a mark, and nothing for the whole library.

    Tables without titles have the one scope of the library.
    """
    title = F.concat(F.lit("="), F.col("title_id").cast("string"))
    if "scope" not in queries.columns:
        queries = queries.withColumn("scope", F.coalesce(title, F.lit("")) if "title_id" in queries.columns else F.lit(""))
    if "scope" not in episodes.columns:
        scopes = F.array_compact(F.array(F.lit(""), title)) if "title_id" in episodes.columns else F.array(F.lit(""))
        episodes = episodes.withColumn("scope", F.explode(scopes))
    return queries, episodes


def _one_each(episodes: DataFrame, *by: str) -> DataFrame:
    """Of the episodes that are equal in ``by`` the one that is taken: many can have one name, and one answers all that ask for it."""
    rest = [c for c in ("season", "episode", "video_id", "name") if c not in by]  # nulls first, as in every choice here
    return episodes.groupBy(*by).agg(F.min(F.struct(*rest)).alias("one")).select(*by, "one.*")


def quoted_episode(queries: DataFrame, episodes: DataFrame) -> DataFrame:
    """The first quoted span that is an episode's name, by the key that names are compared by."""
    queries, episodes = _by_scope(queries, episodes)
    spans = queries.select("query_id", "scope", F.posexplode(T.quoted_spans(F.col("text"))).alias("at", "span")).withColumn("key", T.comparison_key(F.col("span")))
    named = episodes.withColumn("key", T.comparison_key(F.col("name"))).where("key <> ''")
    hits = spans.join(_one_each(named, "scope", "key"), ["scope", "key"])
    return _first(hits, "at", F.asc_nulls_first("season"), F.asc_nulls_first("episode"), "video_id").select("query_id", "video_id", _label().alias("label"))


def unquoted_episode(queries: DataFrame, episodes: DataFrame) -> DataFrame:
    """The longest name of two words or more that stands in the text, case and all.

    Names and texts are read as words and single other characters. A place of a
    text is met by the lengths of the names that begin with its word, and what
    stands there, so long, is looked up whole: names of one first word meet no
    text that doesn't hold them.
    """
    queries, episodes = _by_scope(queries, episodes)
    pieces = lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]"), F.lit(0))
    names = episodes.withColumn("plain", F.translate(T.trimmed(F.col("name")), "’‘", "''")).where(F.size(F.split("plain", f"[{T.BLANK}]+")) >= 2)
    names = _one_each(names, "scope", "plain").withColumn("pieces", pieces(F.col("plain")))
    begins = names.select("scope", F.get("pieces", 0).alias("piece"), F.size("pieces").alias("size")).distinct()
    lines = queries.select("query_id", "scope", pieces(F.translate("text", "’‘", "''")).alias("line"))
    places = lines.select("query_id", "scope", "line", F.posexplode("line").alias("at", "piece"))
    outside = lambda k: ~F.coalesce(F.get("line", k), F.lit(" ")).rlike("[A-Za-z0-9]")
    # words are whole pieces, so only a name that ends in another character can stand next to one
    apart = outside(F.col("at") - 1) & outside(F.col("at") + F.col("size"))
    met = places.join(begins, ["scope", "piece"]).where(F.col("at") + F.col("size") <= F.size("line")).where(apart)
    stands = met.select("query_id", "scope", F.array_join(F.slice("line", F.col("at") + 1, F.col("size")), "").alias("plain"))
    hits = stands.join(names.drop("pieces"), ["scope", "plain"])
    return _first(hits, F.desc(F.length("plain")), F.asc_nulls_first("season"), F.asc_nulls_first("episode"), "video_id").select(
        "query_id", "video_id", _label().alias("label")
    )


def numbered_episode(queries: DataFrame, episodes: DataFrame) -> DataFrame:
    """The episode whose season and number a text gives, forms in their order of trust."""
    queries, episodes = _by_scope(queries, episodes)
    forms = queries.select("query_id", "scope", F.posexplode(T.numbered_episodes(F.col("text"))).alias("at", "n")).select("query_id", "scope", "at", "n.season", "n.episode")
    return _first(forms.join(_one_each(episodes, "scope", "season", "episode"), ["scope", "season", "episode"]), "at", "video_id").select("query_id", "video_id", _label().alias("label"))


def season_scope(queries: DataFrame, episodes: DataFrame) -> DataFrame:
    """``query_id, n_videos, video_id, season, label``: the season that a text names, or the one episode at the end it names.

    A whole season has no ``video_id``; its episodes are rows of ``episodes``, to be
    joined by season where they are needed (:func:`scope_of`).
    """
    queries, episodes = _by_scope(queries, episodes)
    asked = queries.select("query_id", "scope", T.season_number(F.col("text")).alias("season"), T.season_end(F.col("text")).alias("end"))
    one = F.struct("episode", "video_id", "name")
    per = episodes.where("season is not null").groupBy("scope", "season").agg(F.count("*").alias("n"), F.max(one).alias("last"), F.min(one).alias("first"))
    found = asked.join(per, ["scope", "season"]).withColumn("one", F.when(F.col("end") == "last", F.col("last")).when(F.col("end") == "first", F.col("first")))
    single = F.col("one").isNotNull()
    return found.select(
        "query_id",
        F.when(single, F.lit(1)).otherwise(F.col("n")).cast("long").alias("n_videos"),
        F.col("one.video_id").alias("video_id"),
        "season",
        F.when(single, F.format_string("%s (S%dE%d)", "one.name", "season", "one.episode")).otherwise(F.format_string("season %d", "season")).alias("label"),
    )


def scope_of(requests: DataFrame, episodes: DataFrame) -> DataFrame:
    """``query_id, video_id``: the videos that each of :func:`read_requests` names, as rows."""
    requests, episodes = _by_scope(requests, episodes)
    one = requests.where("video_id is not null").select("query_id", "video_id")
    seasons = requests.where("video_id is null and season is not null").select("query_id", "scope", "season")
    return one.unionByName(seasons.join(episodes.select("scope", "season", "video_id"), ["scope", "season"]).select("query_id", "video_id"))


def read_requests(queries: DataFrame, episodes: DataFrame) -> DataFrame:
    """``query_id, text, video_id, season, label, when``: a quoted name before one in prose, before numbers, before a season.

    A quoted name is an address and is taken out of the text, unless nothing
    would be left; a position is read whatever else is. ``season`` is set only
    where a whole season is meant. Queries may have a ``title_id``, which comes
    along; null asks the whole library.
    """
    own = ["title_id"] if "title_id" in queries.columns else []
    queries, episodes = _by_scope(queries, episodes)
    named = lambda df, k: df.select("query_id", F.struct("video_id", F.lit(None).cast("int").alias("season"), "label").alias(k))
    quoted = named(quoted_episode(queries, episodes), "q")
    prose = named(unquoted_episode(queries, episodes), "u")
    number = named(numbered_episode(queries, episodes), "n")
    whole = F.when(F.col("video_id").isNull(), F.col("season"))
    season = season_scope(queries, episodes).select("query_id", F.struct("video_id", whole.alias("season"), "label").alias("s"))
    keys = queries.select("query_id", "scope", F.explode(T.quoted_spans(F.col("text"))).alias("span")).withColumn("key", T.comparison_key(F.col("span")))
    known = episodes.select("scope", T.comparison_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    spans = keys.join(known, ["scope", "key"], "left_semi").groupBy("query_id").agg(F.collect_set("span").alias("names"))
    joined = queries
    for part in (quoted, prose, number, season, spans):
        joined = joined.join(part, "query_id", "left")
    pieces = F.aggregate(
        F.coalesce("names", F.array().cast("array<string>")),
        F.col("text"),
        lambda t, s: F.replace(
            F.replace(F.replace(F.replace(t, F.concat(F.lit('"'), s, F.lit('"')), F.lit(" ")), F.concat(F.lit("“"), s, F.lit("”")), F.lit(" ")),
                      F.concat(F.lit("“"), s, F.lit('"')), F.lit(" ")),
            F.concat(F.lit('"'), s, F.lit("”")), F.lit(" "),
        ),
    )
    left = T.squeeze(pieces)
    text = F.when(F.col("q").isNotNull() & (left != ""), left).otherwise(T.trimmed(F.col("text")))
    return joined.withColumn("where", F.coalesce("q", "u", "n", "s")).select(
        "query_id",
        *own,
        text.alias("text"),
        "where.video_id",
        "where.season",
        "where.label",
        T.position_hint(F.col("text")).alias("when"),
    )
