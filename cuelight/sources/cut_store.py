"""Saved cuts: written whole, patched and deleted by rows that are added, read by the newest of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.sources import commits as C

#: What a patch may change.
PATCHED = ("name", "caption", "clips")


def _rows(spark: SparkSession, out: str) -> DataFrame | None:
    kept = C.committed(spark, out, "cuts")
    return None if kept is None else C.newest(kept, "id", [c for c in kept.columns if c not in ("id", "batch")])


def save_cuts(spark: SparkSession, out: str, cuts: DataFrame) -> None:
    """Add ``cuts(id, title_id, name, …, updated_at)``, or replace those of the same id; every save has the same columns."""
    C.append(spark, out, "cuts", cuts.withColumn("gone", F.lit(False)))


def read_cuts(spark: SparkSession, out: str, title_id: str | None = None) -> DataFrame:
    """Cuts of a title, or all, the last changed first. A folder that nothing was saved in is an error."""
    rows = _rows(spark, out)
    if rows is None:
        raise FileNotFoundError(f"no cuts were saved in {out}")
    kept = rows.where("not gone").drop("gone", "batch")
    return (kept if title_id is None else kept.where(F.col("title_id") == title_id)).orderBy(F.desc("updated_at"), "id")


def patch_cuts(spark: SparkSession, out: str, patches: DataFrame, now_ms: int) -> DataFrame:
    """Change what ``patches(id, …)`` give of :data:`PATCHED`, where it isn't null; the changed cuts. Unknown ids are left out."""
    given = [c for c in PATCHED if c in patches.columns]
    p = patches.select("id", *[F.col(c).alias(f"__{c}") for c in given])
    known = read_cuts(spark, out)
    changed = known.join(p, "id").select(*[F.coalesce(f"__{c}", c).alias(c) if c in given else F.lit(now_ms).cast("long").alias(c) if c == "updated_at" else F.col(c) for c in known.columns])
    batch = C.append(spark, out, "cuts", changed.withColumn("gone", F.lit(False)))
    return spark.read.parquet(f"{out}/cuts/batch={batch}").drop("gone")


def delete_cuts(spark: SparkSession, out: str, ids: DataFrame) -> int:
    """Delete the cuts of ``ids(id)``; how many there were."""
    batch = C.append(spark, out, "cuts", read_cuts(spark, out).join(ids.select("id").distinct(), "id", "left_semi").withColumn("gone", F.lit(True)))
    return spark.read.parquet(f"{out}/cuts/batch={batch}").count()


def compact(spark: SparkSession, out: str) -> None:
    """Write the cuts that are left as one whole batch."""
    batch = C.next_batch(spark, out)
    read_cuts(spark, out).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{out}/cuts/batch={batch}")
    C.commit(spark, out, batch, whole=True)
