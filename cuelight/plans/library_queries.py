"""Catalogue, read-model and maintenance queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.operators import library as L
from cuelight.operators import serving as S
from cuelight.plans import views


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as catalogue items: some without, some with several provider ids."""
    k = F.col("c_custkey")
    ids = F.map_filter(
        F.create_map(
            F.lit("Imdb"), F.when(k % 2 == 0, F.concat(F.lit("tt"), (k % 97).cast("string"))),
            F.lit("Tmdb"), F.when(k % 5 == 0, (k % 89).cast("string")),
            F.lit("Tvdb"), F.when(k % 7 == 0, (k % 83).cast("string")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return views.table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 2 == 0, "Series").otherwise("Movie").alias("kind"), ids.alias("provider_ids")
    )


def scan_catalogue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.collapse_titles(items(spark, sf_dir)).select("id", "name", "kind")


COLLAPSE_SQL = """
WITH i AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'Series' ELSE 'Movie' END AS kind,
         CASE WHEN c_custkey % 7 = 0 THEN 'Tvdb:' || c_custkey % 83 WHEN c_custkey % 5 = 0 THEN 'Tmdb:' || c_custkey % 89 WHEN c_custkey % 2 = 0 THEN 'Imdb:tt' || c_custkey % 97 END AS key
  FROM customer)
SELECT id, name, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY id) AS n FROM i) WHERE key IS NULL OR n = 1"""


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as the tracks of a video."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    stream = F.struct(
        F.col("l_linenumber").alias("index"),
        F.when(p % 3 == 0, "Audio").otherwise("Subtitle").alias("type"),
        F.when(s % 5 == 0, "rus").when(s % 5 == 1, "eng").when(s % 5 == 2, "und").when(s % 5 == 3, F.lit(None)).otherwise("en-US").alias("language"),
        (p % 4 == 0).alias("is_default"),
        (p % 5 == 0).alias("is_forced"),
        (p % 7 != 0).alias("is_text"),
        (s % 3 == 0).alias("is_sdh"),
        p.alias("part"),
    )
    return views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(stream)).alias("streams"))


STREAMS_SQL = """
s AS (
  SELECT l_orderkey, l_linenumber AS index, l_partkey AS part, l_partkey % 3 = 0 AS audio,
         CASE l_suppkey % 5 WHEN 0 THEN 'rus' WHEN 1 THEN 'eng' WHEN 2 THEN 'und' WHEN 4 THEN 'en-us' END AS lang,
         l_partkey % 4 = 0 AS def, l_partkey % 5 = 0 AS forced, l_partkey % 7 <> 0 AS is_text, l_suppkey % 3 = 0 AS sdh FROM lineitem)
"""


def track_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streams(spark, sf_dir).select("l_orderkey", L.pick_subtitle(F.col("streams")).alias("subtitle"), L.pick_audio(F.col("streams")).alias("audio"))


TRACK_SQL = f"""
WITH {STREAMS_SQL},
b AS (SELECT l_orderkey, arg_min(index, struct_pack(a := -(CASE WHEN lang LIKE 'en%' THEN 8 ELSE 0 END + CASE WHEN NOT forced THEN 4 ELSE 0 END + CASE WHEN NOT sdh THEN 2 ELSE 0 END + CASE WHEN def THEN 1 ELSE 0 END), i := index)) AS subtitle
      FROM s WHERE NOT audio AND is_text AND (lang IS NULL OR lang LIKE 'en%' OR lang = 'und') GROUP BY l_orderkey),
a AS (SELECT l_orderkey, min(index) AS audio FROM s WHERE audio AND lang LIKE 'en%' GROUP BY l_orderkey)
SELECT o.l_orderkey, subtitle, audio FROM (SELECT DISTINCT l_orderkey FROM s) o LEFT JOIN b USING (l_orderkey) LEFT JOIN a USING (l_orderkey)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as videos of their nation, with a status by balance."""
    b = F.col("c_acctbal")
    return views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("video_id"), F.col("c_nationkey").alias("title_id"), F.when(b < 0, "none").when(b < 1000, "error").when(b < 2000, "pending").otherwise("ok").alias("subtitle_status")
    )


VIDEOS_SQL = """
videos AS (
  SELECT c_custkey AS video_id, c_nationkey AS title_id, CASE WHEN c_acctbal < 0 THEN 'none' WHEN c_acctbal < 1000 THEN 'error' WHEN c_acctbal < 2000 THEN 'pending' ELSE 'ok' END AS subtitle_status
  FROM customer)
"""


def library_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.missing_subtitles(titles(spark, sf_dir), videos(spark, sf_dir))


def title_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "orders").join(videos(spark, sf_dir), F.col("o_custkey") == F.col("video_id")).select("title_id")
    return L.title_counts(titles(spark, sf_dir), videos(spark, sf_dir), lines)


COUNTS_SQL = f"""
WITH {VIDEOS_SQL}
SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM videos WHERE title_id = n_nationkey AND subtitle_status = 'ok') AS video_count,
       (SELECT count(*) FROM orders JOIN videos ON o_custkey = video_id WHERE title_id = n_nationkey) AS line_count FROM nation"""


def remote_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as remote titles with what the library knows of them: indexed or not, and counts."""
    known = views.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("line_count"), F.max("l_shipdate").alias("indexed_at"))
    return L.annotate_remote(views.table(spark, sf_dir, "part").select("p_partkey", "p_name"), known, "p_partkey")


REMOTE_SQL = """
SELECT p_partkey, p_name, n IS NOT NULL AS indexed, coalesce(n, 0) AS line_count
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) ON p_partkey = l_partkey"""


def latest_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer, by date and then key."""
    o = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return L.latest(o, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that are asked for, each once, and have no order in progress."""
    asked = views.table(spark, sf_dir, "customer").select("c_custkey")
    there = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return L.missing_ids(asked.unionByName(asked), there, "c_custkey")


def removal_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and shipped lines that would go with each nation of a region."""
    gone = views.table(spark, sf_dir, "nation").where("n_regionkey in (0, 3)").select(F.col("n_nationkey").alias("title_id"))
    cuts = views.table(spark, sf_dir, "orders").join(views.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("title_id"))
    renders = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("montage_id"), F.when(F.col("l_linestatus") == "F", "done").otherwise("running").alias("status"))
    return L.removal_cost(gone, cuts, renders)


COST_SQL = """
WITH m AS (SELECT o_orderkey AS id, c_nationkey AS title_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (0, 3)),
d AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT title_id, count(*) AS montages, CAST(coalesce(sum(n), 0) AS BIGINT) AS renders FROM m LEFT JOIN d ON id = l_orderkey GROUP BY title_id"""


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each table has left after the titles of a region go, with all that hangs on them."""
    gone = views.table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("title_id"))
    lines = views.table(spark, sf_dir, "orders").join(videos(spark, sf_dir), F.col("o_custkey") == F.col("video_id"))
    left = L.cascade({"title": (titles(spark, sf_dir), "id"), "video": (videos(spark, sf_dir), "title_id"), "line": (lines, "title_id")}, gone)
    parts = [df.select(F.lit(name).alias("tab"), (F.col("title_id") if name != "title" else F.col("id")).alias("title_id")) for name, df in left.items()]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("tab", "title_id").agg(F.count("*").alias("n"))


CASCADE_SQL = f"""
WITH {VIDEOS_SQL}, g AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 2)
SELECT 'title' AS tab, k AS title_id, 1 AS n FROM g
UNION ALL SELECT 'video', title_id, count(*) FROM videos WHERE title_id IN (SELECT k FROM g) GROUP BY title_id
UNION ALL SELECT 'line', title_id, count(*) FROM orders JOIN videos ON o_custkey = video_id WHERE title_id IN (SELECT k FROM g) GROUP BY title_id"""


def incremental_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of some orders replaced; an order that comes back without lines loses those it had."""
    old = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    touched = old.where("l_orderkey % 10 = 3").select("l_orderkey")
    new = old.where("l_orderkey % 20 = 3 and l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") + 1000)
    out = L.replace_by(old, new, touched, "l_orderkey")
    return out.groupBy((F.col("l_orderkey") % 100).alias("bucket")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


REPLACE_SQL = """
WITH r AS (
  SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 3
  UNION ALL SELECT l_orderkey, l_quantity + 1000 FROM lineitem WHERE l_orderkey % 20 = 3 AND l_linenumber <= 2)
SELECT l_orderkey % 100 AS bucket, count(*) AS n, sum(l_quantity) AS quantity FROM r GROUP BY ALL"""


def upsert_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known parts take name and size of a newer catalogue, and keep the rest; new ones come whole."""
    p = views.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    old = p.where("p_partkey % 3 <> 0")
    new = p.where("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("new "), "p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"), F.lit("other").alias("p_brand"))
    return L.upsert(old, new, "p_partkey", ["p_name", "p_size"])


UPSERT_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END AS p_size,
       CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE 'other' END AS p_brand
FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0"""


def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents still to index: those that have no good label yet."""
    done = views.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return L.remaining(views.table(spark, sf_dir, "documents").select("doc_id", "lang"), done, "doc_id")


def cache_evict_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cached files, one shelf a priority, each held to a fixed size."""
    files = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("shelf"), F.col("o_orderkey").alias("path"), F.floor(F.col("o_totalprice")).alias("size"), ((F.col("o_orderkey") * 7919) % 100_003).alias("mtime_ms")
    )
    return L.eviction_plan(files, 50_000_000).select("shelf", "path")


EVICT_SQL = """
WITH f AS (SELECT o_orderpriority AS shelf, o_orderkey AS path, CAST(floor(o_totalprice) AS BIGINT) AS size, (o_orderkey * 7919) % 100003 AS m FROM orders)
SELECT shelf, path FROM (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY shelf ORDER BY m, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(size) OVER (PARTITION BY shelf) - 50000000 AS excess FROM f)
WHERE gone < excess"""


def tick_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to milliseconds, halves up on either side of zero."""
    t = F.col("l_partkey") * 12_345 - F.col("l_suppkey") * 2_500
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.ticks_to_ms(t).alias("ms"), (L.ticks_to_ms(t) * 10_000).alias("ticks"))


def episode_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a title's videos by season and number, those without first."""
    c = views.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("title_id"), F.col("c_custkey").alias("video_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 6).alias("season"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 11).alias("episode")
    )
    return L.ordered_videos(c.withColumn("name", F.lit(""))).select("title_id", "video_id", "place")


EPISODES_SQL = """
SELECT c_nationkey AS title_id, c_custkey AS video_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 6 END NULLS FIRST,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 11 END NULLS FIRST, c_custkey) AS INT) AS place FROM customer"""


def media_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment addresses with a bit rate by width, held between two bounds."""
    k, width = F.col("p_partkey").cast("string"), 100 + F.col("p_size") * 40
    url = S.segment_url(F.lit("http://media.example//"), k, F.concat(F.lit("source "), k), F.col("p_partkey") * 10_000, width)
    return views.table(spark, sf_dir, "part").select("p_partkey", url.alias("url"))


URLS_SQL = """
SELECT p_partkey, 'http://media.example/Videos/' || p_partkey || '/stream?mediaSourceId=source+' || p_partkey || '&startTimeTicks=' || (p_partkey * 10000) ||
  '&maxWidth=' || (100 + p_size * 40) || '&videoBitRate=' || greatest(1500000, least(12000000, (100 + p_size * 40) * 8000)) || '&allowVideoStreamCopy=false' AS url FROM part"""



def media_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of files, previews and pictures; every third file leaves its source to the server, every second preview its sound."""
    k = F.col("p_partkey")
    base, key, video = F.lit("http://media.example//"), F.concat(F.lit("key-"), k.cast("string")), F.concat(F.lit("v "), k.cast("string"))
    return views.table(spark, sf_dir, "part").select(
        "p_partkey",
        S.stream_url(base, video, F.when(k % 3 != 0, k.cast("string")), key).alias("stream"),
        S.preview_url(base, video, k * 17, key, audio=F.when(k % 2 == 0, k % 5)).alias("preview"),
        S.image_url(base, video, key).alias("image"),
    )


ADDRESSES_SQL = """
SELECT p_partkey, 'http://media.example/Videos/v+' || p_partkey || '/stream?static=true' || CASE WHEN p_partkey % 3 <> 0 THEN '&mediaSourceId=' || p_partkey ELSE '' END || '&ApiKey=key-' || p_partkey AS stream,
  'http://media.example/Videos/v+' || p_partkey || '/stream.mp4?static=false&container=mp4&videoCodec=h264&audioCodec=aac&allowVideoStreamCopy=true&allowAudioStreamCopy=true&enableAutoStreamCopy=true&maxWidth=640&startTimeTicks=' ||
    (p_partkey * 170000) || '&deviceId=preview' || CASE WHEN p_partkey % 2 = 0 THEN '&AudioStreamIndex=' || (p_partkey % 5) ELSE '' END || '&ApiKey=key-' || p_partkey AS preview,
  'http://media.example/Items/v+' || p_partkey || '/Images/Primary?maxHeight=400&ApiKey=key-' || p_partkey AS image FROM part"""


QUERIES = {
    f.__name__: f
    for f in (
        scan_catalogue_dedupe, track_pick, library_rollup, title_counts, remote_annotate, latest_render, missing_ids, removal_cost, cascade_delete,
        incremental_replace, upsert_titles, resume_skip, cache_evict_plan, tick_conversion, episode_order, media_urls, media_addresses,
    )
}
SQL = {
    "scan_catalogue_dedupe": COLLAPSE_SQL,
    "track_pick": TRACK_SQL,
    "library_rollup": f"WITH {VIDEOS_SQL} SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM videos WHERE title_id = n_nationkey AND subtitle_status IN ('none', 'error')) AS missing FROM nation",
    "title_counts": COUNTS_SQL,
    "remote_annotate": REMOTE_SQL,
    "latest_render": "SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS status FROM orders GROUP BY o_custkey",
    "missing_ids": "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)",
    "removal_cost": COST_SQL,
    "cascade_delete": CASCADE_SQL,
    "incremental_replace": REPLACE_SQL,
    "upsert_titles": UPSERT_SQL,
    "resume_skip": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "cache_evict_plan": EVICT_SQL,
    "tick_conversion": "SELECT l_orderkey, l_linenumber, CAST(floor((l_partkey * 12345 - l_suppkey * 2500) / 10000 + 0.5) AS BIGINT) AS ms, CAST(floor((l_partkey * 12345 - l_suppkey * 2500) / 10000 + 0.5) AS BIGINT) * 10000 AS ticks FROM lineitem",
    "episode_order": EPISODES_SQL,
    "media_urls": URLS_SQL,
    "media_addresses": ADDRESSES_SQL,
}
