"""Append-only tables that change one batch at a time.

A folder holds tables and, beside them, ``commits``. A batch writes its rows under
its own number, ``<table>/batch=<n>``, and then one row into ``commits``, which is
there after the writer's rename or isn't. Readers take the batches that have that
row. A batch that broke off is not seen, and its number is written over by the
next. A whole batch stands for all before it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "batch long, job string, step long, whole boolean"


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A folder as a table; none where there is no such folder yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def commits(spark: SparkSession, out: str) -> DataFrame:
    """``batch, job, step, whole``: a row for each batch that was committed since the last whole one."""
    # the number is the folder's name, so that a row and its number can't differ
    kept = table(spark, f"{out}/commits", "job string, step long, whole boolean, batch long")
    if kept is None:
        return spark.createDataFrame([], COMMIT)
    since = kept.agg(F.coalesce(F.max(F.when(F.col("whole"), F.col("batch"))), F.lit(-1)).alias("since"))
    return kept.crossJoin(F.broadcast(since)).where("batch >= since").select("batch", "job", "step", "whole")  # one row


def next_batch(spark: SparkSession, out: str) -> int:
    """The number of the next batch; batches of a folder are written one at a time."""
    return commits(spark, out).agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]


def commit(spark: SparkSession, out: str, batch: int, job: str | None = None, step: int | None = None, whole: bool = False) -> None:
    """One row in one file."""
    row = spark.createDataFrame([(job, step, whole)], "job string, step long, whole boolean")
    row.coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/batch={batch}")


def committed(spark: SparkSession, out: str, name: str, known: DataFrame | None = None) -> DataFrame | None:
    """The rows of a table that count, with their ``batch``; none where nothing was written."""
    kept = table(spark, f"{out}/{name}")
    if kept is None:
        return None
    known = (commits(spark, out) if known is None else known).select(F.col("batch").cast("int").alias("batch"))
    return kept.join(F.broadcast(known), "batch", "left_semi")  # as many rows as batches since the last whole one


def newest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, columns, batch``: of each key's rows the one of the newest batch."""
    return rows.groupBy(key).agg(F.max_by(F.struct("batch", *columns), "batch").alias("__n")).select(key, *[f"__n.{c}" for c in columns], "__n.batch")


def append(spark: SparkSession, out: str, name: str, rows: DataFrame, job: str | None = None) -> int:
    """One batch of one table, committed; its number."""
    batch = next_batch(spark, out)
    rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
    commit(spark, out, batch, job)
    return batch
