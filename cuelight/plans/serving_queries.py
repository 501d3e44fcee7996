"""Queries over lookups, edges and styles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import cut as C
from cuelight.operators import serving as S
from cuelight.plans import views
from cuelight.plans.cut_queries import CLIPS_SQL, bounds


def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the keys of large orders, each once."""
    items = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return S.multi_get(items, views.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id")))


def children_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as titles, every third a film; customers as the episodes of the others."""
    n = views.table(spark, sf_dir, "nation")
    titles = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "Movie").otherwise("Series").alias("kind"))
    episodes = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("title_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("video_id"), F.col("c_name").alias("name"))
    return S.children(titles, episodes)


CHILDREN_SQL = """
SELECT CAST(n_nationkey AS VARCHAR) AS title_id, CAST(n_nationkey AS VARCHAR) AS video_id, n_name AS name FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'c' || c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 3 <> 0"""


def move_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each clip moved to where they are dragged, and the clip slid, within limits."""
    b = bounds(spark, sf_dir)
    of = [F.col(c) for c in ("start_ms", "end_ms", "s", "e")]
    k = F.col("cut_id") * 10 + F.col("pos")
    slid = C.move_clip((k * 977) % 60_001 - 30_000, *of)
    return b.select(
        "cut_id", "pos", C.move_edge("start", F.col("s") + (k * 613) % 50_001 - 25_000, *of).alias("start_to"), C.move_edge("end", F.col("e") + (k * 719) % 50_001 - 25_000, *of).alias("end_to"), slid[0].alias("slid_start"), slid[1].alias("slid_end")
    )


EDGES_SQL = f"""
WITH {CLIPS_SQL}, x AS (SELECT *, cut_id * 10 + pos AS k, greatest(0, start_ms - 15000) AS lo, end_ms + 15000 AS hi FROM bounds),
y AS (SELECT *, greatest(lo - s, least(hi - e, (k * 977) % 60001 - 30000)) AS d FROM x)
SELECT cut_id, pos, least(e - 250, greatest(lo, s + (k * 613) % 50001 - 25000)) AS start_to, least(hi, greatest(s + 250, e + (k * 719) % 50001 - 25000)) AS end_to, s + d AS slid_start, e + d AS slid_end FROM y"""


def spine_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bounds(spark, sf_dir)
    n = C.tiles(F.col("s"), F.col("e"))
    return b.select(
        "cut_id", "pos", F.array_join(C.spine_tiles(n, (F.col("pos") * 3).cast("int")).cast("array<string>"), ",").alias("tiles"), F.round(C.tile_offset_percent(F.lit(1), n), 6).alias("offset"), F.round(C.time_at_percent(F.col("s"), F.col("e"), F.col("pos") * 20.0 - 10), 6).alias("at_ms")
    )


SPINE_SQL = f"""
WITH {CLIPS_SQL}, t AS (SELECT *, CAST(greatest(1, least(96, floor(greatest(500, e - s) / 500 + 0.5))) AS INT) AS n FROM bounds), w AS (SELECT *, greatest(1, least(n, pos * 3)) AS m FROM t)
SELECT cut_id, pos, CASE WHEN m = 1 THEN '0' ELSE array_to_string(list_transform(range(0, m), lambda i: CAST(floor(i / (m - 1) * (n - 1) + 0.5) AS INT)), ',') END AS tiles,
       round(CASE WHEN n > 1 THEN 1 / (n - 1) * 100 ELSE 0 END, 6) AS offset, round(s + (e - s) * greatest(0, least(100, CAST(pos AS DOUBLE) * 20 - 10)) / 100, 6) AS at_ms FROM w"""


def caption_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    place = F.when(k % 3 == 0, "auto").when(k % 3 == 1, "top").otherwise("bottom")
    return p.select("p_partkey", C.caption_style(F.col("p_size") * 24, k % 2 == 0, (k % 40) / 10, place).alias("s")).select("p_partkey", "s.*")


STYLES_SQL = """
WITH p AS (SELECT p_partkey, p_size * 24 AS h, p_partkey % 2 = 0 AS meme, greatest(CAST(0.5 AS DOUBLE), least(CAST(3 AS DOUBLE), (p_partkey % 40) / 10)) AS z, p_partkey % 3 AS pl FROM part),
q AS (SELECT *, CASE WHEN meme THEN CAST(0.085 AS DOUBLE) ELSE CAST(0.055 AS DOUBLE) END AS f, CASE WHEN meme THEN CAST(0.006 AS DOUBLE) ELSE CAST(0.004 AS DOUBLE) END AS o, CASE WHEN meme THEN CAST(0.04 AS DOUBLE) ELSE CAST(0.035 AS DOUBLE) END AS g FROM p)
SELECT p_partkey, CAST(floor(h * f * z + 0.5) AS INT) AS font, CAST(greatest(2, floor(h * o * z + 0.5)) AS INT) AS outline, CAST(floor(h * g + 0.5) AS INT) AS margin,
       CASE WHEN pl = 1 OR (pl = 0 AND meme) THEN 8 ELSE 2 END AS alignment, CASE WHEN meme THEN -1 ELSE 0 END AS bold FROM q"""


def chosen_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    cuts = m.select(F.col("l_orderkey").alias("cut_id"), F.transform("m", lambda x: x["l_partkey"]).alias("alternates"), F.array(F.lit(2), F.lit(0), F.lit(-1), F.lit(5)).alias("chosen"))
    return S.chosen_scenes(cuts).select("cut_id", "pos", "alternate_index", F.col("match").alias("part"))


CHOSEN_SQL = """
WITH m AS (SELECT l_orderkey AS cut_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY ALL)
SELECT cut_id, CAST(pos AS INT) AS pos, CAST(i AS INT) AS alternate_index, a[i + 1] AS part FROM m, (VALUES (0, 2), (1, 0), (2, -1), (3, 5)) AS c(pos, i) WHERE i >= 0 AND i < len(a)"""


def reviewed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cut_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("texts"))
    return S.reviewed(docs).select("cut_id", F.size("texts").cast("long").alias("n"), F.sha2(F.array_join("texts", "\n"), 256).alias("texts_sha256"))


REVIEWED_SQL = """
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:60] AS l FROM documents)
SELECT doc_id AS cut_id, len(l) AS n, sha256(array_to_string(l, chr(10))) AS texts_sha256 FROM t"""


QUERIES = {f.__name__: f for f in (multi_get, children_scan, move_edges, spine_tiles, caption_styles, chosen_scenes, reviewed_lists)}
SQL = {
    "multi_get": "SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "children_scan": CHILDREN_SQL,
    "move_edges": EDGES_SQL,
    "spine_tiles": SPINE_SQL,
    "caption_styles": STYLES_SQL,
    "chosen_scenes": CHOSEN_SQL,
    "reviewed_lists": REVIEWED_SQL,
}
