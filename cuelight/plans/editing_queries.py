"""Queries over cuts and read models, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.operators import editing as E
from cuelight.operators import library as L
from cuelight.plans import views
from cuelight.plans.cut_queries import CLIPS_SQL, bounds


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cuts, their lines as clips in order; some clips without a match."""
    clip = F.struct("l_linenumber", "l_partkey", (F.col("l_suppkey") % 4 == 0).alias("lost"), (F.col("l_suppkey") % 3 == 0).alias("own_caption"))
    return views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(clip)).alias("clips"))


CUTS_SQL = """
cuts AS (SELECT l_orderkey, list(struct_pack(n := l_linenumber, p := l_partkey, lost := l_suppkey % 4 = 0, own := l_suppkey % 3 = 0) ORDER BY l_linenumber, l_partkey, l_suppkey % 4 = 0, l_suppkey % 3 = 0) AS clips FROM lineitem GROUP BY ALL)
"""


def montage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _orders(spark, sf_dir)
    query = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("ask "), F.col("l_orderkey").cast("string"))).otherwise("")
    first = F.get("clips", 0)
    video = F.when(~first["lost"], F.concat(F.lit("video "), (first["l_partkey"] % 10).cast("string")))
    return c.select("l_orderkey", E.cut_name(query, F.size("clips"), video, first["l_partkey"] * 1499).alias("name"))


NAMES_SQL = f"""
WITH {CUTS_SQL}, t AS (SELECT *, CAST(floor(clips[1].p * 1499 / 1000 + 0.5) AS BIGINT) AS s FROM cuts)
SELECT l_orderkey, CASE WHEN len(clips) > 1 AND l_orderkey % 3 = 0 THEN 'ask ' || l_orderkey || ' · ' || len(clips) || ' scenes'
  WHEN NOT clips[1].lost THEN 'video ' || clips[1].p % 10 || ' · ' || CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
  ELSE 'Untitled clip' END AS name FROM t"""


def clip_list_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cut's clips after one is put in at the second place and the first two are swapped."""
    ids = F.transform("clips", lambda c: c["l_partkey"])
    put = _orders(spark, sf_dir).select("l_orderkey", E.insert_at(ids, F.lit(1), F.lit(-1).cast("long")).alias("put"))
    return put.select("l_orderkey", F.array_join(E.swap_neighbours(F.col("put"), F.lit(0)).cast("array<string>"), ",").alias("clips"))


LIST_SQL = f"""
WITH {CUTS_SQL}, p AS (SELECT l_orderkey, list_transform(clips, lambda c: c.p) AS ids FROM cuts)
SELECT l_orderkey, array_to_string([-1, ids[1]] || ids[2:], ',') AS clips FROM p"""


def montage_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts with the name of their title, or that it is unknown, and what there is to fix in them."""
    titles = views.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("title_id"), F.col("o_orderpriority").alias("name"))
    c = L.montage_summaries(_orders(spark, sf_dir).withColumn("title_id", F.col("l_orderkey")), titles)
    return c.select("l_orderkey", "title", "n_clips", E.unmatched(F.col("clips"), "lost").alias("unmatched"), E.overridden(F.col("clips"), "own_caption").alias("overridden"))


SUMMARIES_SQL = f"""
WITH {CUTS_SQL}, t AS (SELECT o_orderkey, o_orderpriority AS title FROM orders WHERE o_orderstatus <> 'P')
SELECT l_orderkey, coalesce(title, 'Unknown') AS title, len(clips) AS n_clips, len(list_filter(clips, lambda c: c.lost)) AS unmatched, len(list_filter(clips, lambda c: c.own)) AS overridden
FROM cuts LEFT JOIN t ON o_orderkey = l_orderkey"""


def montage_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with patches: what a patch leaves out stays."""
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    patches = o.where(k % 2 == 0).select("o_orderkey", F.when(k % 4 == 0, F.lit("X")).alias("o_orderstatus"), F.when(k % 6 == 0, F.lit("patched")).alias("o_orderpriority"))
    return E.save_patch(o, patches, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bounds(spark, sf_dir)
    lost = F.col("pos") % 3 == 2
    return E.render_plan(b.select("cut_id", F.col("pos"), F.when(~lost, F.col("s")).alias("start_ms"), F.when(~lost, F.col("e")).alias("end_ms")).dropDuplicates(["cut_id", "pos"])).select("cut_id", "pos", "segment", "progress")


PLAN_SQL = f"""
WITH {CLIPS_SQL}, k AS (SELECT DISTINCT cut_id, pos FROM bounds WHERE pos % 3 <> 2)
SELECT cut_id, pos, CAST(row_number() OVER (PARTITION BY cut_id ORDER BY pos) - 1 AS INT) AS segment,
       round(row_number() OVER (PARTITION BY cut_id ORDER BY pos) / count(*) OVER (PARTITION BY cut_id) * CAST(0.85 AS DOUBLE), 6) AS progress FROM k"""


def export_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "gif").when(k % 4 == 1, "mp4").when(k % 4 == 2, "png").otherwise("webm")
    width = F.when(k % 3 != 0, F.col("p_size") * 60)
    return p.select("p_partkey", E.render_settings(kind, width, F.when(k % 5 != 0, k % 90)).alias("s")).select("p_partkey", "s.*")


SETTINGS_SQL = """
WITH p AS (SELECT p_partkey AS k, p_size, CASE p_partkey % 4 WHEN 0 THEN 'gif' WHEN 1 THEN 'mp4' WHEN 2 THEN 'png' ELSE 'webm' END AS kind FROM part)
SELECT k AS p_partkey, CAST(greatest(160, least(1920, CASE WHEN k % 3 <> 0 THEN p_size * 60 WHEN kind = 'gif' THEN 480 ELSE 720 END)) AS INT) AS width,
       CAST(greatest(5, least(60, CASE WHEN k % 5 <> 0 THEN k % 90 WHEN kind = 'gif' THEN 15 ELSE 24 END)) AS INT) AS fps, kind NOT IN ('gif', 'png') AS sound FROM p"""


def title_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of every title in order, with their subtitle status, those without numbers first."""
    c = F.col("c_custkey")
    v = views.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("title_id"), c.alias("video_id"), F.col("c_name").alias("name"),
        F.when(c % 4 != 0, c % 6).alias("season"), F.when(c % 5 != 0, c % 11).alias("episode"), F.when(F.col("c_acctbal") < 0, "none").otherwise("ok").alias("status"),
    )
    return L.ordered_videos(v)


DETAIL_SQL = """
WITH v AS (SELECT c_nationkey AS title_id, c_custkey AS video_id, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 6 END AS season,
           CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 11 END AS episode, CASE WHEN c_acctbal < 0 THEN 'none' ELSE 'ok' END AS status FROM customer)
SELECT *, CAST(row_number() OVER (PARTITION BY title_id ORDER BY season NULLS FIRST, episode NULLS FIRST, name, video_id) AS INT) AS place FROM v"""


def library_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many titles of each facet hold a word, whatever its case, and how many of them can be searched."""
    p = views.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_size", F.when(F.col("p_retailprice") > 1000, 1).otherwise(0).alias("line_count"))
    return L.facet_counts(L.holding(p, "E"), F.when(F.col("p_size") < 20, "series").otherwise("movies"))


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of an encoder's reports, made of orders: each class, two at once, signals, and none."""
    o, k = views.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    said = F.element_at(F.array(*map(F.lit, REPORTS)), (k % len(REPORTS) + 1).cast("int"))
    report = F.when(k % 13 != 0, F.concat(F.lit("frame= "), k.cast("string"), F.lit("\n\n"), said, F.lit("\nGET /v?api_key="), F.md5(k.cast("string")), F.lit("&t="), k.cast("string"), F.lit("\n a\nb\nc\nd\n")))
    signal = F.when(k % 17 == 0, "SIGSEGV").when(k % 19 == 0, "SIGKILL")
    kind = E.failure_class(report, signal)
    shown = F.when(kind == "other", E.explain_failure(report, signal))
    return o.select("o_orderkey", kind.alias("kind"), shown.alias("tail"))


REPORTS = (
    "Server returned 401 Unauthorized", "Connection timed out", "404 Not Found", "403 forbidden", "Connection refused", "x.mp4: No such file or directory", "Fontconfig error: cannot load",
    "Invalid data found", "network is unreachable; operation timed out", "Conversion failed!",
)


def _failures_sql() -> str:
    said = ", ".join(f"'{r}'" for r in REPORTS)
    classes = " ".join(f"WHEN regexp_matches(coalesce(report, ''), '{p}') THEN '{n}'" for n, p, _ in E.FAILURES)
    return f"""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN 'frame= ' || o_orderkey || chr(10) || chr(10) || ([{said}])[o_orderkey % {len(REPORTS)} + 1] || chr(10) || 'GET /v?api_key=' || md5(o_orderkey::VARCHAR) || '&t=' || o_orderkey || chr(10) || ' a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) END AS report,
  CASE WHEN o_orderkey % 17 = 0 THEN 'SIGSEGV' WHEN o_orderkey % 19 = 0 THEN 'SIGKILL' END AS signal FROM orders),
k AS (SELECT *, CASE WHEN signal = 'SIGSEGV' THEN 'crash' WHEN signal <> '' THEN 'killed' {classes} WHEN report IS NOT NULL THEN 'other' END AS kind FROM r)
SELECT o_orderkey, kind, CASE WHEN kind = 'other' THEN ([{said}])[o_orderkey % {len(REPORTS)} + 1] || chr(10) || 'GET /v?api_key=REDACTED&t=' || o_orderkey || chr(10) || ' a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' END AS tail FROM k"""


QUERIES = {f.__name__: f for f in (failure_classes, montage_names, clip_list_edits, montage_summaries, montage_patch, render_plan, export_settings, title_detail, library_filters)}
SQL = {
    "failure_classes": _failures_sql(),
    "montage_names": NAMES_SQL,
    "clip_list_edits": LIST_SQL,
    "montage_summaries": SUMMARIES_SQL,
    "montage_patch": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 'patched' ELSE o_orderpriority END AS o_orderpriority FROM orders",
    "render_plan": PLAN_SQL,
    "export_settings": SETTINGS_SQL,
    "title_detail": DETAIL_SQL,
    "library_filters": "SELECT CASE WHEN p_size < 20 THEN 'series' ELSE 'movies' END AS facet, count(*) AS n, count(*) FILTER (p_retailprice > 1000) AS searchable FROM part WHERE contains(lower(p_name), 'e') GROUP BY ALL",
}
