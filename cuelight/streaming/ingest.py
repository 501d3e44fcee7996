"""Incremental indexing of subtitle files, and windows over an event stream.

An index is a folder of the tables ``lines``, ``postings`` and ``status``, which change by
:mod:`cuelight.sources.commits`: a video's rows are those of the newest batch that has a status for
it. So a video is replaced as a whole or not at all, and nothing is rewritten
while it is read; :func:`compact` gathers what counts into one batch.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cuelight.functions import text as T
from cuelight.functions import vectors as V
from cuelight.operators import postings as P
from cuelight.operators.subtitles import dialogue_windows, lines_of, parse_subtitles
from cuelight.sources import commits as C
from cuelight.sources.subtitle_files import stream_subtitles

# Notes of videos without lines.
NO_TRACK, EMPTY_TRACK = "no text subtitle track", "subtitle track was empty"
#: What a cancelled run raises between two batches.
CANCELLED = "the index run was cancelled"


def _write(spark: SparkSession, out: str, batch: int, lines: DataFrame) -> DataFrame:
    """Lines and postings of a batch; the lines as they were written."""
    lines.sortWithinPartitions("video_id").write.mode("overwrite").parquet(f"{out}/lines/batch={batch}")
    written = spark.read.parquet(f"{out}/lines/batch={batch}")
    P.write_postings(P.build_postings(written), f"{out}/postings/batch={batch}")
    return written


def index_batch(files: DataFrame, title_of: DataFrame, out: str, dim: int = 384, job: str | None = None, step: int | None = None) -> DataFrame:
    """Index one batch of files under ``out``, its statuses; of a video's files the newest counts.

    A batch replaces the lines of its videos; one that has no line any more has
    none. A null body is a video without a text track; a file with an ``error``
    gets that as its note, and its video no line. A ``step`` of a ``job`` that
    was committed isn't done again. Batches are committed one at a time.
    """
    spark = files.sparkSession
    known = C.commits(spark, out)
    if job is not None:
        done = known.where((F.col("job") == job) & (F.col("step") == step)).first()
        if done is not None:
            return spark.read.parquet(f"{out}/status/batch={done['batch']}")
    batch = C.next_batch(spark, out)
    newest = Window.partitionBy("video_id").orderBy(F.desc("modificationTime"), "body")
    files = files.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")
    if "error" not in files.columns:
        files = files.withColumn("error", F.lit(None).cast("string"))
    good = files.where("error is null and body is not null")
    lines = lines_of(dialogue_windows(parse_subtitles(good)), title_of).withColumn("embedding", V.hash_embedding(F.col("text"), dim))
    written = _write(spark, out, batch, lines)
    there = written.groupBy("video_id").agg(F.count("*").alias("n"), F.sum(F.size(T.index_tokens(F.col("text")))).cast("long").alias("tokens"))
    note = F.coalesce("error", F.when(F.col("body").isNull(), NO_TRACK).when(F.col("n").isNull(), EMPTY_TRACK))
    status = files.join(there, "video_id", "left").select(
        "video_id",
        F.when(F.col("error").isNotNull(), "error").when(F.col("n").isNotNull(), "ok").otherwise("none").alias("status"),
        note.alias("note"),
        F.coalesce("n", F.lit(0)).cast("long").alias("line_count"),
        F.coalesce("tokens", F.lit(0)).cast("long").alias("token_count"),
    )
    status.write.mode("overwrite").parquet(f"{out}/status/batch={batch}")
    C.commit(spark, out, batch, job, step)
    return spark.read.parquet(f"{out}/status/batch={batch}")


def read_status(spark: SparkSession, out: str) -> DataFrame:
    """``video_id, status, note, line_count, token_count, batch``: the newest committed status of every video."""
    kept = C.committed(spark, out, "status")
    if kept is None:
        return spark.createDataFrame([], "video_id string, status string, note string, line_count long, token_count long, batch int")
    return C.newest(kept, "video_id", ["status", "note", "line_count", "token_count"])


def _current(spark: SparkSession, out: str, rows: DataFrame) -> DataFrame:
    """``rows(video_id, batch, …)`` of the batch that a video's newest status is of."""
    return rows.join(read_status(spark, out).select("video_id", "batch"), ["video_id", "batch"], "left_semi").drop("batch")


def read_lines(spark: SparkSession, out: str) -> DataFrame:
    """Lines of the index as it was last committed."""
    return _current(spark, out, spark.read.parquet(f"{out}/lines"))


def read_postings(spark: SparkSession, out: str, terms: DataFrame | None = None) -> DataFrame:
    """Postings of the same lines; for ``terms(term)`` from the folders that can hold them."""
    return _current(spark, out, P.read_postings(spark, f"{out}/postings", terms))


def read_sizes(spark: SparkSession, out: str) -> DataFrame:
    """``video_id, n_lines, n_tokens`` of videos with lines, for :func:`cuelight.operators.postings.corpus_of`."""
    return read_status(spark, out).where("line_count > 0").select("video_id", F.col("line_count").alias("n_lines"), F.col("token_count").alias("n_tokens"))


def compact(spark: SparkSession, out: str) -> None:
    """Write what counts as one whole batch; earlier ones are read no more, and their folders can be removed."""
    batch = C.next_batch(spark, out)
    status = read_status(spark, out).drop("batch")
    _write(spark, out, batch, read_lines(spark, out))
    status.write.mode("overwrite").parquet(f"{out}/status/batch={batch}")
    C.commit(spark, out, batch, whole=True)


def run_counts(status: DataFrame) -> DataFrame:
    """One row: videos processed, those indexed, without lines and failed, and lines."""
    of = lambda s: F.count_if(F.col("status") == s)
    return status.agg(F.count("*").alias("processed"), of("ok").alias("indexed"), of("none").alias("skipped"), of("error").alias("failed"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"))


def job_progress(spark: SparkSession, out: str, job: str) -> DataFrame:
    """:func:`run_counts` of the batches that ``job`` has committed so far: of a video done twice the last status counts."""
    kept = C.committed(spark, out, "status", C.commits(spark, out).where(F.col("job") == job))
    if kept is None:
        return run_counts(read_status(spark, out))
    return run_counts(kept.groupBy("video_id").agg(F.max_by("status", "batch").alias("status"), F.max_by("line_count", "batch").alias("line_count")))


def cancel(spark: SparkSession, out: str, job: str) -> None:
    """Ask a job to stop before its next batch."""
    spark.createDataFrame([(job,)], "job string").coalesce(1).write.mode("append").parquet(f"{out}/cancels")


def resume(spark: SparkSession, out: str, job: str) -> None:
    """Take a request to cancel back, so that the job may be started again."""
    spark.createDataFrame([(job,)], "job string").coalesce(1).write.mode("append").parquet(f"{out}/resumes")


def is_cancelled(spark: SparkSession, out: str, job: str) -> bool:
    times = [0 if t is None else t.where(F.col("job") == job).count() for t in (C.table(spark, f"{out}/cancels", "job string"), C.table(spark, f"{out}/resumes", "job string"))]
    return times[0] > times[1]


def start_indexing(
    spark: SparkSession, path: str, title_of: DataFrame, out: str, checkpoint: str, dim: int = 384, files_per_batch: int = 1000, job: str | None = None
) -> StreamingQuery:
    """Index the files that came since the last run, then stop; a video that is done is not read again.

    Each batch is committed by itself, and ``job`` (the checkpoint's folder where
    none is named) can be cancelled between two.
    """
    job = job or checkpoint

    def step(batch: DataFrame, number: int) -> None:
        if is_cancelled(batch.sparkSession, out, job):
            raise RuntimeError(CANCELLED)
        index_batch(batch, title_of, out, dim, job, number)

    return (
        stream_subtitles(spark, path, files_per_batch)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(step)
        .start()
    )


def run_indexing(spark: SparkSession, path: str, title_of: DataFrame, out: str, checkpoint: str, **options) -> str:
    """:func:`start_indexing` to its end: ``done``, or ``cancelled``. Any other failure is raised."""
    try:
        start_indexing(spark, path, title_of, out, checkpoint, **options).awaitTermination()
    except StreamingQueryException as e:
        if CANCELLED in str(e):
            return "cancelled"
        raise
    return "done"


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour and type, closed once the watermark has passed (an extension for event streams)."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("hour"), "event_type", "n")
    )
