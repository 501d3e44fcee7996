"""Pasted text to a list of scene descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.operators.hints import _by_scope
from cuelight.session import sent

# The marker line of a promoted post, the lines that close one, and a line that is one quotation.
OPENS = rf"(?i)\A[{T.BLANK}]*(ad|promoted)[{T.BLANK}]*\z"
CLOSES = rf"(?i)\A[{T.BLANK}]*(thumbnail image:|[a-z0-9-]+(\.[a-z0-9-]+)+[{T.BLANK}]*\z)"
WRAPPED = "\\A['‘]([^'‘’]+)['’]\\z"


def drop_promoted(lines: DataFrame, reach: int = 12) -> DataFrame:
    """``lines(doc_id, pos, line)`` without promoted posts.

    A post opens with a bare marker line and closes with the first picture
    caption or bare domain within ``reach`` lines; one that doesn't close stays.
    A marker inside an open post opens nothing, so the posts of a paste are
    found by a fold over the places of its markers and closers only, and no
    other line is shuffled. Places of a paste's lines follow one another.
    """
    marks = lines.select("doc_id", "pos", F.col("line").rlike(OPENS).alias("opens"), F.col("line").rlike(CLOSES).alias("closes")).where("opens or closes")
    after = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(1, reach - 1)
    spans = marks.withColumn("end", F.min(F.when(F.col("closes"), F.col("pos"))).over(after)).where("opens and end is not null")
    posts = spans.groupBy("doc_id").agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("pos", "end"))),
            F.array().cast("array<struct<pos:int,end:int>>"),
            lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["pos"]), acc).otherwise(F.concat(acc, F.array(s))),
        ).alias("posts")
    )
    inside = F.exists("posts", lambda p: (p["pos"] <= F.col("pos")) & (p["end"] >= F.col("pos")))
    return lines.join(sent(posts), "doc_id", "left").where(F.coalesce(~inside, F.lit(True))).drop("posts")


def split_descriptions(pastes: DataFrame, episodes: DataFrame | None = None, run_on: int = 200, most: int = 60) -> DataFrame:
    """``pastes(doc_id, text)`` to ``doc_id, pos, description``, at most ``most`` a paste.

    Quoted spans that aren't episode names stand for their line; with a ``title_id``
    in ``pastes`` the names are those of its title. A paste that is
    one long line of prose is cut into sentences. Of descriptions equal but for
    case and punctuation the first stays.
    """
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    lines = pastes.select("doc_id", F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    clean = drop_promoted(lines).select("doc_id", "pos", T.normalise_line(F.col("line")).alias("line"))
    spans = F.filter(F.transform(T.quoted_spans(F.col("line")), T.trimmed), T.usable)
    if episodes is None:
        quotes = clean.withColumn("quotes", spans)
    else:
        scopes, named = _by_scope(pastes, episodes)
        names = named.select("scope", T.comparison_key(F.col("name")).alias("key")).where("key <> ''").distinct()
        each = clean.select("doc_id", "pos", F.posexplode(spans).alias("at", "span")).withColumn("key", T.comparison_key(F.col("span")))
        each = each.join(scopes.select("doc_id", "scope").distinct(), "doc_id")
        said = each.join(names, ["scope", "key"], "left_anti").groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "span"))).alias("q"))
        quotes = clean.join(said.select("doc_id", "pos", F.transform("q", lambda s: s["span"]).alias("quotes")), ["doc_id", "pos"], "left")
        quotes = quotes.withColumn("quotes", F.coalesce("quotes", F.array().cast("array<string>")))
    unwrapped = T.trimmed(F.regexp_replace("line", WRAPPED, "$1"))
    parts = F.when(F.size("quotes") > 0, F.transform("quotes", lambda q: F.struct(q.alias("text"), F.lit(True).alias("quote")))).otherwise(
        F.array(F.struct(unwrapped.alias("text"), F.lit(False).alias("quote")))
    )
    candidates = quotes.select("doc_id", "pos", F.posexplode(parts).alias("at", "c")).select("doc_id", "pos", "at", "c.text", "c.quote").where(T.usable(F.col("text")))
    alone = F.count("*").over(Window.partitionBy("doc_id")) == 1
    cut = T.once(F.filter(T.sentences(F.col("text")), T.usable), lambda found: F.when(F.size(found) > 1, found).otherwise(F.array("text")))
    pieces = F.when(F.col("alone") & ~F.col("quote") & (F.length("text") > run_on), cut).otherwise(F.array("text"))
    rows = candidates.withColumn("alone", alone).select("doc_id", "pos", "at", F.posexplode(pieces).alias("part", "text"))
    first = Window.partitionBy("doc_id", "key").orderBy("pos", "at", "part")
    unique = rows.withColumn("key", T.distinct_key(F.col("text"))).withColumn("n", F.row_number().over(first)).where("n = 1")
    order = Window.partitionBy("doc_id").orderBy("pos", "at", "part")
    return unique.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), F.col("text").alias("description")).where(F.col("pos") < most)
