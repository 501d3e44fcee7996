"""A session with the settings the library is written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to every task at most.
SENT = 100_000


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Adaptive execution on (coalescing, skew joins), UTC, Arrow on; spent checkpoints are removed."""
    builder = SparkSession.builder.master(master).appName("cuelight")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


def _checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, set where it is known or the machine is the only one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, and read back."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def sent(df: DataFrame) -> DataFrame:
    """``df``, few short rows as a rule, cut and marked to be sent to every task; if it has more than :data:`SENT` it is joined by shuffles."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= SENT else kept


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the checkpoint folder, for a table that is written and read in one query."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
