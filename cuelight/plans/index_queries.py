"""Queries over the keyword index, vectors, labels and edits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.functions import vectors as V
from cuelight.operators import editing as E
from cuelight.operators import library as L
from cuelight.operators import postings as P
from cuelight.operators import serving as S
from cuelight.plans import views
from cuelight.plans.retrieval_queries import TERMS_SQL
from cuelight.plans.views import LINES_SQL, REQUESTS_SQL


def match_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions as expressions of a keyword index; null where no term is left."""
    return views.requests(spark, sf_dir).select("query_id", T.match_expression(T.query_terms(F.col("text"))).alias("expression"))


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positional index by term: lines, occurrences, the sum of their places, the longest line."""
    kept = P.build_postings(views.spoken(spark, sf_dir), stemmed=False)
    places = F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x)
    return kept.groupBy("term").agg(F.count("*").alias("n_lines"), F.sum(F.size("places")).alias("n"), F.sum(places).alias("places"), F.max("len").alias("longest"))


def index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and tokens of every video, and what they make of the corpus."""
    sizes = P.build_sizes(views.spoken(spark, sf_dir))
    corpus = P.corpus_of(sizes)
    return sizes.crossJoin(F.broadcast(corpus)).select("video_id", "n_lines", "n_tokens", "total", F.round("avg_len", 6).alias("avg_len"))  # one row


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = V.normalised(F.col("embedding").cast("array<double>"))
    v = views.vectors(spark, sf_dir).select("line_id", unit.alias("u"))
    return v.select("line_id", F.round(V.dot(F.col("u"), F.col("u")), 3).alias("length"), F.round(F.get("u", 0).cast("double"), 3).alias("first"), F.round(F.element_at("u", -1).cast("double"), 3).alias("last"))


def episode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    season, episode = F.when(c % 4 != 0, (c % 13).cast("int")), F.when(c % 5 != 0, (c % 101).cast("int"))
    return views.table(spark, sf_dir, "customer").select("c_custkey", T.episode_label(F.col("c_name"), season, episode).alias("label"))


def edits_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of orders' lines in one form, by number as text; none where a line, or all of them, are too long."""
    key = F.concat(F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))
    said = F.concat(F.col("l_returnflag"), F.lit(" "), F.repeat(F.lit("ab "), (F.col("l_quantity") * 2 + F.when(F.col("l_orderkey") % 50 == 0, 200).otherwise(0)).cast("int")))
    # one edit for each key, as a map has
    lines = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", key.alias("k")).agg(F.max(said).alias("v"))
    edits = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("edits"))
    return edits.select("l_orderkey", F.sha1(E.canonical_edits(F.col("edits"))).alias("address"))


def picture_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of one source each, their lines as its streams: the source and the first picture among them."""
    kind = F.when(F.col("l_suppkey") % 3 == 0, "Video").when(F.col("l_suppkey") % 3 == 1, "Audio").otherwise("Subtitle")
    stream = F.struct("l_linenumber", "l_partkey", kind.alias("type"))
    k = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(stream)).alias("streams"))
    sources = F.array(F.struct(F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("id"), F.col("streams")))
    return k.select("l_orderkey", S.primary_source(sources).alias("source"), S.video_stream(sources)["l_linenumber"].alias("stream"))


def served_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders that have good standing: what is asked for and there, each once."""
    videos = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"), F.when(F.col("c_acctbal") < 0, "none").otherwise("ok").alias("subtitle_status"))
    return L.indexed_videos(views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id")), videos)


QUERIES = {f.__name__: f for f in (match_expressions, index_terms, index_sizes, unit_vectors, episode_labels, edits_address, picture_streams, served_videos)}
WORDS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
SQL = {
    "match_expressions": f"""WITH {REQUESTS_SQL}, {TERMS_SQL}, x AS (SELECT query_id, string_agg('"' || replace(term, '"', '""') || '"', ' OR ' ORDER BY pos) AS expression FROM terms GROUP BY query_id)
SELECT query_id, expression FROM requests LEFT JOIN x USING (query_id)""",
    "index_terms": f"""WITH {LINES_SQL}, t AS (SELECT line_id, {WORDS_SQL} AS w FROM lines), p AS (SELECT line_id, len(w) AS n, w[i] AS term, i - 1 AS place FROM t, unnest(range(1, len(w) + 1)) AS r(i))
SELECT term, count(DISTINCT line_id) AS n_lines, count(*) AS n, CAST(sum(place) AS BIGINT) AS places, CAST(max(n) AS INT) AS longest FROM p GROUP BY term""",
    "index_sizes": f"""WITH {LINES_SQL}, t AS (SELECT video_id, len({WORDS_SQL}) AS n FROM lines), c AS (SELECT count(*) AS total, avg(n) AS avg_len FROM t)
SELECT video_id, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_tokens, any_value(total) AS total, round(any_value(avg_len), 6) AS avg_len FROM t, c GROUP BY video_id""",
    "unit_vectors": """WITH v AS (SELECT vec_id AS line_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM v)
SELECT line_id, CAST(CASE WHEN l > 0 THEN 1 ELSE 0 END AS DOUBLE) AS length, round(e[1] / CASE WHEN l > 0 THEN l ELSE 1 END, 3) AS first, round(e[len(e)] / CASE WHEN l > 0 THEN l ELSE 1 END, 3) AS last FROM n""",
    "episode_labels": """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 THEN 'S' || lpad(CAST(c_custkey % 13 AS VARCHAR), CAST(greatest(2, length(CAST(c_custkey % 13 AS VARCHAR))) AS INT), '0') || 'E' ||
  lpad(CAST(c_custkey % 101 AS VARCHAR), CAST(greatest(2, length(CAST(c_custkey % 101 AS VARCHAR))) AS INT), '0') || ' ' || c_name ELSE c_name END AS label FROM customer""",
    "edits_address": """WITH e AS (SELECT l_orderkey, l_linenumber || '-' || l_partkey AS k, max(l_returnflag || ' ' || repeat('ab ', CAST(l_quantity * 2 + CASE WHEN l_orderkey % 50 = 0 THEN 200 ELSE 0 END AS INT))) AS v FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE WHEN max(length(v)) <= 300 AND sum(length(v)) <= 8000 THEN sha1('{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}') END AS address FROM e GROUP BY l_orderkey""",
    "picture_streams": """SELECT l_orderkey, 's' || l_orderkey AS source, min(l_linenumber) FILTER (l_suppkey % 3 = 0) AS stream FROM lineitem GROUP BY l_orderkey""",
    "served_videos": "SELECT c_custkey AS video_id, 'ok' AS subtitle_status FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT o_custkey FROM orders)",
}
