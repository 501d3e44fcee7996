"""Views of the library's tables over those that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as cues of videos."""
    c, t = F.col("conv_id"), F.col("turn")
    start = t * 2500 + F.floor((c * 3 + t) / 4) * 4000
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select(
        c.cast("string").alias("video_id"), t.alias("turn"), start.alias("start_ms"), (start + 1500 + (c * 7 + t * 13) % 3000).alias("end_ms"), F.coalesce("text", F.lit("")).alias("text")
    )
    from pyspark.sql import Window

    order = Window.partitionBy("video_id").orderBy("start_ms", "turn")
    return rows.select("video_id", (F.row_number().over(order) - 1).alias("cue"), "start_ms", "end_ms", "text")


CUES_SQL = """
cues AS (
  SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_ms, turn) - 1 AS INT) AS cue, start_ms, end_ms, text
  FROM (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn,
               turn * 2500 + ((conv_id * 3 + turn) // 4) * 4000 AS start_ms,
               turn * 2500 + ((conv_id * 3 + turn) // 4) * 4000 + 1500 + (conv_id * 7 + turn * 13) % 3000 AS end_ms,
               coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL))
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as lines, with the vectors of the same ids; null where there is none."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        i.alias("line_id"),
        F.col("source").alias("title_id"),
        F.col("lang").alias("video_id"),
        (i * 7000).alias("start_ms"),
        (i * 7000 + 4000).alias("end_ms"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_id"), "embedding")
    return docs.join(vectors, "line_id", "left")


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`lines` without their vectors, as often as there: texts aren't shuffled, as a line meets only ids of vectors that repeat."""
    from cuelight.session import sent

    i = F.col("doc_id")
    ids = table(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))
    often = F.explode(F.array_repeat(F.lit(0), F.coalesce("n", F.lit(1))))
    docs = table(spark, sf_dir, "documents").join(sent(ids.where("n > 1")), "doc_id", "left").withColumn("one", often)
    return docs.select(
        i.alias("line_id"), F.col("source").alias("title_id"), F.col("lang").alias("video_id"), (i * 7000).alias("start_ms"), (i * 7000 + 4000).alias("end_ms"), F.coalesce("text", F.lit("")).alias("text")
    )


LINES_SQL = """
lines AS (
  SELECT doc_id AS line_id, source AS title_id, lang AS video_id, doc_id * 7000 AS start_ms, doc_id * 7000 + 4000 AS end_ms,
         coalesce(text, '') AS text, CAST(embedding AS DOUBLE[]) AS embedding
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("line_id"), "embedding", F.col("label").cast("string").alias("title_id"), (F.col("vec_id") % 7).cast("string").alias("video_id")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as descriptions, each with the vector of its id."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(v, "query_id")


REQUESTS_SQL = """
requests AS (
  SELECT item_id AS query_id, text, CAST(embedding AS DOUBLE[]) AS embedding FROM benchmark JOIN embeddings ON item_id = vec_id)
"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, numbered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


TEXT_LINES_SQL = """
text_lines AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS pos, l[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i))
"""
