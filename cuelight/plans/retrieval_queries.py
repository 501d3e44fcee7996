"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelight.functions import text as T
from cuelight.functions import vectors as V
from cuelight.operators import retrieval as R
from cuelight.plans import views
from cuelight.plans.views import LINES_SQL, REQUESTS_SQL

DISTANCE = "greatest(0, 1 - list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))))"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TERMS_SQL = f"""
terms AS (
  SELECT query_id, CAST(i - 1 AS INT) AS pos, t[i] AS term
  FROM (SELECT query_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}'']+'), lambda t: length(t) > 1 AND t NOT IN ({STOP})) AS t FROM requests),
       unnest(range(1, len(t) + 1)) AS r(i))
"""
TOKENS_SQL = """
tokens AS (SELECT line_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM lines),
corpus AS (SELECT count(*) AS total, avg(len(t)) AS avg_len FROM tokens),
hits AS (
  SELECT term, line_id, count(*) AS tf, any_value(n) AS len
  FROM (SELECT line_id, len(t) AS n, unnest(t) AS term FROM tokens) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term)
"""
#: Every vector whose id is divisible by 50 is a query of the batch search.
EVERY = 50


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return views.table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.knn(views.vectors(spark, sf_dir), _query_vector(spark, sf_dir), 40)
    return found.select("line_id", "title_id", F.round("distance", 6).alias("distance"), F.round(V.score(F.col("distance")), 6).alias("score"))


def _knn_sql(where: str, extra: str) -> str:
    return f"""
SELECT line_id, {extra} round(d, 6) AS distance, round(greatest(0, 1 - d / 2), 6) AS score
FROM (SELECT b.vec_id AS line_id, CAST(b.label AS VARCHAR) AS title_id, {DISTANCE} AS d
      FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) b,
           (SELECT CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings ORDER BY vec_id LIMIT 1) a {where})
ORDER BY d, line_id LIMIT 40"""


def knn_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.knn(views.vectors(spark, sf_dir), _query_vector(spark, sf_dir), 40, title_id="1")
    return found.select("line_id", F.round("distance", 6).alias("distance"), F.round(V.score(F.col("distance")), 6).alias("score"))


def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.vectors(spark, sf_dir)
    queries = lines.where(F.col("line_id") % EVERY == 0).select(F.col("line_id").alias("query_id"), "embedding")
    return R.knn_batch(lines, queries, 10).select("query_id", "line_id", F.round("distance", 6).alias("distance"), "rank")


KNN_BATCH_SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)
SELECT query_id, line_id, round(d, 6) AS distance, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, line_id) AS rank
      FROM (SELECT a.vec_id AS query_id, b.vec_id AS line_id, {DISTANCE} AS d FROM v a, v b WHERE a.vec_id % {EVERY} = 0))
WHERE rank <= 10"""


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.terms_of(views.requests(spark, sf_dir))


def term_df_idf_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rare = R.term_rarity(views.lines(spark, sf_dir), R.terms_of(views.requests(spark, sf_dir)))
    return rare.select("term", "df", "total", F.round("idf", 6).alias("idf"), "rare")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.bm25(views.lines(spark, sf_dir), views.requests(spark, sf_dir), 10, min_idf=3.0, stemmed=False)
    return found.select("query_id", "line_id", F.round("bm25", 6).alias("bm25"), "rank")


def _bm25_sql(k: int, min_idf: float) -> str:
    return f"""
scored AS (
  SELECT query_id, line_id,
         round(sum(times * greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS bm25
  FROM (SELECT query_id, term, count(*) AS times FROM terms GROUP BY ALL) JOIN df USING (term) JOIN hits USING (term), corpus
  WHERE ln(total / df) >= {min_idf} GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, line_id) AS rank FROM scored) WHERE rank <= {k})
"""


def _vector_sql(k: int) -> str:
    return f"""
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, line_id) AS rank
  FROM (SELECT a.query_id, b.line_id, {DISTANCE} AS distance FROM requests a, lines b WHERE b.embedding IS NOT NULL)) WHERE rank <= {k})
"""


FUSED_SQL = """
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, v_rank ASC NULLS LAST, line_id) AS pos
  FROM (SELECT query_id, line_id, v.rank AS v_rank, w.rank AS l_rank, v.distance,
               round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(CAST(1.5 AS DOUBLE) / (60 + w.rank), 0), 12) AS rrf
        FROM vector v FULL OUTER JOIN lexical w USING (query_id, line_id)))
"""


def _fused(spark: SparkSession, sf_dir: str, min_idf: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines, queries = views.lines(spark, sf_dir), views.requests(spark, sf_dir)
    return lines, queries, R.fuse(R.knn_batch(lines, queries, 40), R.bm25(lines, queries, 40, min_idf, stemmed=False))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = _fused(spark, sf_dir, 3.0)[2]
    return fused.select("query_id", "line_id", "v_rank", "l_rank", F.round("rrf", 9).alias("rrf"), "pos")


def distance_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, queries, fused = _fused(spark, sf_dir, 3.0)
    filled = R.backfill(fused, queries, lines)
    return filled.select("query_id", "line_id", F.round("distance", 6).alias("distance"), F.round(V.score(F.col("distance")), 6).alias("score"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: five distinct moments for every description."""
    found = R.hybrid_search(views.lines(spark, sf_dir), views.requests(spark, sf_dir), 5, min_idf=3.0, stemmed=False)
    return found.select("query_id", "place", "line_id", "title_id", "video_id", "start_ms", "score")


HYBRID_SQL = f"""
WITH RECURSIVE {LINES_SQL}, {REQUESTS_SQL}, {TERMS_SQL}, {TOKENS_SQL}, {_bm25_sql(40, 3.0)}, {_vector_sql(40)}, {FUSED_SQL},
placed AS (SELECT f.query_id, f.pos, l.line_id, l.video_id, l.start_ms FROM fused f JOIN lines l USING (line_id)),
ordered AS (SELECT query_id, list({{'line_id': line_id, 'video_id': video_id, 'start_ms': start_ms}} ORDER BY pos) AS c FROM placed GROUP BY query_id),
walk AS (
  SELECT query_id, c, 1 AS i, CAST([] AS STRUCT(line_id BIGINT, video_id VARCHAR, start_ms BIGINT)[]) AS kept FROM ordered
  UNION ALL
  SELECT query_id, c, i + 1,
         CASE WHEN len(list_filter(kept, lambda x: x.video_id = c[i].video_id AND abs(x.start_ms - c[i].start_ms) < 20000)) > 0 THEN kept ELSE list_append(kept, c[i]) END
  FROM walk WHERE i <= len(c) AND len(kept) < 5),
done AS (SELECT query_id, arg_max(kept, i) AS kept FROM walk GROUP BY query_id),
best AS (SELECT query_id, i - 1 AS place, kept[i].line_id AS line_id FROM done, unnest(range(1, len(kept) + 1)) AS r(i))
SELECT b.query_id, CAST(place AS INT) AS place, b.line_id, l.title_id, l.video_id, l.start_ms, CASE WHEN l.embedding IS NULL THEN 0 ELSE round(greatest(0, 1 - ({DISTANCE.replace('b.embedding', 'l.embedding')}) / 2), 6) END AS score
FROM best b JOIN lines l USING (line_id) JOIN requests a ON a.query_id = b.query_id"""


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without a time zone, whatever the session's zone."""
    since = f"({ts} - timestamp_ntz'1970-01-01 00:00:00')"
    part = lambda unit: f"extract({unit} from {since})"
    return F.expr(f"cast(({part('day')} * 86400 + {part('hour')} * 3600 + {part('minute')} * 60 + {part('second')}) * 1000000 as long)")


def greedy_distinct_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour by value, no two kept of one video within five minutes."""
    e = views.table(spark, sf_dir, "events")
    moments = e.select(
        F.floor(micros("ts") / 3_600_000_000).alias("query_id"), (-F.col("value")).alias("order"), F.col("event_id").alias("line_id"),
        (F.col("user_id") % 3).cast("string").alias("video_id"), F.floor(micros("ts") / 1000).alias("start_ms"),
    )
    return R.distinct_of_many(moments, 8, 300_000, ["order"])


GREEDY_SQL = """
WITH RECURSIVE m AS (
  SELECT epoch_us(ts) // 3600000000 AS query_id, event_id AS line_id, CAST(user_id % 3 AS VARCHAR) AS video_id, epoch_us(ts) // 1000 AS start_ms, value FROM events),
ordered AS (SELECT query_id, list({'line_id': line_id, 'video_id': video_id, 'start_ms': start_ms} ORDER BY value DESC, line_id) AS c FROM m GROUP BY query_id),
walk AS (
  SELECT query_id, c, 1 AS i, CAST([] AS STRUCT(line_id BIGINT, video_id VARCHAR, start_ms BIGINT)[]) AS kept FROM ordered
  UNION ALL
  SELECT query_id, c, i + 1,
         CASE WHEN len(list_filter(kept, lambda x: x.video_id = c[i].video_id AND abs(x.start_ms - c[i].start_ms) < 300000)) > 0 THEN kept ELSE list_append(kept, c[i]) END
  FROM walk WHERE i <= len(c) AND len(kept) < 8),
done AS (SELECT query_id, arg_max(kept, i) AS kept FROM walk GROUP BY query_id)
SELECT query_id, CAST(i - 1 AS INT) AS place, kept[i].line_id AS line_id, kept[i].video_id AS video_id, kept[i].start_ms AS start_ms
FROM done, unnest(range(1, len(kept) + 1)) AS r(i)"""


def position_band_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the named videos of each description, those in the wanted part first."""
    lines = views.lines(spark, sf_dir)
    videos = lines.groupBy("video_id").agg(F.max("end_ms").alias("runtime_ms"))
    queries = views.requests(spark, sf_dir).select(
        "query_id",
        "embedding",
        F.when(F.col("query_id") % 3 == 0, "opening").when(F.col("query_id") % 3 == 1, "ending").alias("when"),
    )
    named = F.explode(F.array(F.when(F.col("query_id") % 2 == 0, "en").otherwise("de"), F.lit("fr")))
    return R.preferred(lines, queries, queries.select("query_id", named.alias("video_id")), videos, 5).select("query_id", "line_id", "band", "pos")


BAND_SQL = f"""
WITH {LINES_SQL}, {REQUESTS_SQL},
videos AS (SELECT video_id, max(end_ms) AS runtime_ms FROM lines GROUP BY video_id),
q AS (SELECT query_id, embedding, CASE query_id % 3 WHEN 0 THEN 'opening' WHEN 1 THEN 'ending' END AS w, unnest([CASE WHEN query_id % 2 = 0 THEN 'en' ELSE 'de' END, 'fr']) AS video_id FROM requests),
s AS (SELECT a.query_id, b.line_id, round(CASE WHEN b.embedding IS NULL THEN 2 ELSE {DISTANCE} END, 9) AS d,
        CASE WHEN w IS NULL THEN 0 WHEN w = 'opening' AND runtime_ms > 0 AND start_ms <= CAST(runtime_ms AS DOUBLE) * CAST(0.15 AS DOUBLE) THEN 0
             WHEN w = 'ending' AND runtime_ms > 0 AND start_ms >= CAST(runtime_ms AS DOUBLE) * CAST(0.85 AS DOUBLE) THEN 0 ELSE 1 END AS band
      FROM q a JOIN lines b USING (video_id) JOIN videos USING (video_id))
SELECT query_id, line_id, CAST(band AS INT) AS band, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY band, d, line_id) AS pos FROM s) WHERE pos <= 5"""


def context_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around every fiftieth line of its video."""
    lines = views.lines(spark, sf_dir).drop("embedding", "text")
    moments = lines.where("line_id % 50 = 0").withColumnRenamed("line_id", "moment_id")
    return R.context(lines, moments).select("moment_id", "line_id", "start_ms", "end_ms")


CONTEXT_SQL = f"""
WITH {LINES_SQL}
SELECT m.line_id AS moment_id, l.line_id, l.start_ms, l.end_ms FROM lines l JOIN lines m USING (video_id)
WHERE m.line_id % 50 = 0 AND l.end_ms > m.start_ms - 15000 AND l.start_ms < m.end_ms + 15000"""


def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    return docs.select("doc_id", V.hash_embedding(F.coalesce("text", F.lit("")), 64).alias("embedding"))


def lsh_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours of every fiftieth vector: candidates share one of sixteen hashes, then exact distances."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    v = views.vectors(spark, sf_dir).where("embedding is not null").select("line_id", "embedding", array_to_vector(V.normalised(F.col("embedding"))).alias("unit"))
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=0.5, numHashTables=16, seed=7).fit(v)
    # a hash is a vector of one whole number
    number = lambda h: F.regexp_replace(h.cast("string"), r"[\[\]]", "").cast("double").cast("int")
    hashed = model.transform(v).select("line_id", "embedding", F.transform("hashes", number).alias("hashes"))
    return R.hash_batch(hashed, hashed.where(F.col("line_id") % EVERY == 0).withColumnRenamed("line_id", "query_id"), 10)


def cell_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every fiftieth vector by a partitioned index of all of them, written and probed."""
    from cuelight.operators import vector_index as X
    from cuelight.session import shared_folder

    v = views.vectors(spark, sf_dir).select("line_id", "embedding")
    path, centres = shared_folder(spark, "cells"), X.fit_cells(v)
    X.write_index(v, path, centres)
    asked = v.where(F.col("line_id") % EVERY == 0).withColumnRenamed("line_id", "query_id")
    found = X.search_index(spark, path, asked, 10, centres, X.probes_for(v, centres, 10))
    return found.select("query_id", "line_id", F.round("distance", 6).alias("distance"), "rank")


QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, knn_scoped, knn_batch, query_terms, term_df_idf_gate, bm25_topk, rrf_fusion, distance_backfill, hybrid_search,
        greedy_distinct_moments, position_band_rank, context_overlap, embed_hash, lsh_knn, cell_knn,
    )
}
SQL = {
    "knn_topk": _knn_sql("", "title_id,"),
    "knn_scoped": _knn_sql("WHERE CAST(label AS VARCHAR) = '1'", ""),
    "knn_batch": KNN_BATCH_SQL,
    "query_terms": f"WITH {REQUESTS_SQL}, {TERMS_SQL} SELECT query_id, pos, term FROM terms",
    "term_df_idf_gate": f"""WITH {LINES_SQL}, {REQUESTS_SQL}, {TERMS_SQL}, {TOKENS_SQL}
SELECT term, coalesce(df, 0) AS df, total, round(ln(total / df), 6) AS idf, coalesce(ln(total / df) >= 6, false) AS rare
FROM (SELECT DISTINCT term FROM terms) LEFT JOIN df USING (term), corpus""",
    "bm25_topk": f"WITH {LINES_SQL}, {REQUESTS_SQL}, {TERMS_SQL}, {TOKENS_SQL}, {_bm25_sql(10, 3.0)} SELECT query_id, line_id, round(bm25, 6) AS bm25, CAST(rank AS INT) AS rank FROM lexical",
    "rrf_fusion": f"WITH {LINES_SQL}, {REQUESTS_SQL}, {TERMS_SQL}, {TOKENS_SQL}, {_bm25_sql(40, 3.0)}, {_vector_sql(40)}, {FUSED_SQL} SELECT query_id, line_id, CAST(v_rank AS INT) AS v_rank, CAST(l_rank AS INT) AS l_rank, round(rrf, 9) AS rrf, CAST(pos AS INT) AS pos FROM fused",
    "distance_backfill": f"""WITH {LINES_SQL}, {REQUESTS_SQL}, {TERMS_SQL}, {TOKENS_SQL}, {_bm25_sql(40, 3.0)}, {_vector_sql(40)}, {FUSED_SQL}
SELECT f.query_id, f.line_id, round(CASE WHEN b.embedding IS NULL THEN 2 ELSE {DISTANCE} END, 6) AS distance, round(CASE WHEN b.embedding IS NULL THEN 0 ELSE greatest(0, 1 - {DISTANCE} / 2) END, 6) AS score
FROM fused f JOIN requests a ON a.query_id = f.query_id JOIN lines b ON b.line_id = f.line_id""",
    "hybrid_search": HYBRID_SQL,
    "greedy_distinct_moments": GREEDY_SQL,
    "position_band_rank": BAND_SQL,
    "context_overlap": CONTEXT_SQL,
}
