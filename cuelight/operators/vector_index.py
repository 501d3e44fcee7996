"""A partitioned index of vectors: cells of a coarse quantiser as folders, exact distances inside those that are probed.

Centres are fitted on a bounded sample; every vector is in the index, in the cell of
its nearest centre. A search reads the cells whose centres are nearest to
its queries and no others. How many are probed is chosen by the true neighbours of a sample; all cells are the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.operators.retrieval import CHUNK, QUERY_BLOCK, _nearest, _packed, knn_batch

#: Vectors that the centres are fitted on at most, cells at most, and rounds of the fit.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1024, 12
#: Queries that the number of probes is chosen by.
CALIBRATION = 256


def _units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n > 0, n, 1)[:, None]


def fit_cells(vectors: DataFrame, key: str = "line_id", cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Centres of spherical k-means, from the vectors with the smallest hashes of their keys, :data:`SAMPLE` at most.

    As many as the square root of the number of vectors, unless it is given. An
    empty table has one centre of no length.
    """
    known = vectors.where("embedding is not null")
    n = known.count()
    if not n:
        return np.zeros((1, 1))
    cells = max(1, min(MOST_CELLS, round(n**0.5) if cells is None else cells, n))
    taken = known.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    x = _units(taken)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        there = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(there[:, None], _units(sums), centres)
    return centres


def nearest_cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``rows`` with ``cells``: the ``probes`` nearest centres of ``embedding``, nearest first. Centres are at most 1,024 vectors."""

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            near = np.argsort(-(_units(vectors) @ centres.T), axis=1, kind="stable")[:, :probes]
            yield pd.Series(list(near.astype(np.int32)))

    return rows.where("embedding is not null").withColumn("cells", of("embedding"))


def write_index(vectors: DataFrame, path: str, centres: np.ndarray) -> None:
    """``vectors(line_id, embedding)`` in a folder a cell; a cell is dealt to several files by id, however large it is."""
    placed = nearest_cells(vectors.select("line_id", "embedding"), centres, 1).withColumn("cell", F.get("cells", 0)).drop("cells")
    placed.repartition("cell", F.expr("pmod(xxhash64(line_id), 8)")).write.mode("overwrite").partitionBy("cell").parquet(path)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, centres: np.ndarray, probes: int) -> DataFrame:
    """``query_id, line_id, distance, rank`` of the ``k`` nearest lines in the ``probes`` nearest cells of every query.

    Cells that no query probes aren't read (their numbers, 1,024 at most, come
    to the driver). Queries of a cell meet its lines as matrix products.
    """
    asked = nearest_cells(queries.select("query_id", "embedding"), centres, probes).select("query_id", "embedding", F.explode("cells").alias("cell"))
    cells = [r.cell for r in asked.select("cell").distinct().collect()]
    lines = spark.read.parquet(path).where(F.col("cell").isin(cells))
    pairs = _packed(lines, "line_id", CHUNK, "line", "cell").join(_packed(asked, "query_id", QUERY_BLOCK, "query", "cell"), "cell")
    return _nearest(pairs, k)


def probes_for(vectors: DataFrame, centres: np.ndarray, k: int, at_least: float = 0.95, queries: int = CALIBRATION, seed: int = 11) -> int:
    """The fewest cells to probe so that the share ``at_least`` of all true neighbours of a sample of the vectors lies in them.

    The sample's neighbours are found by the exact search over all vectors; where the
    cell of each stands in its query's order of cells is how many it takes.
    """
    known = vectors.where("embedding is not null").select("line_id", "embedding")
    asked = known.orderBy(F.xxhash64("line_id", F.lit(seed)), "line_id").limit(queries).withColumnRenamed("line_id", "query_id")
    exact = knn_batch(known, asked, k).select("query_id", "line_id")
    own = nearest_cells(known, centres, 1).select("line_id", F.get("cells", 0).alias("cell"))
    order = nearest_cells(asked, centres, len(centres)).select("query_id", "cells")
    taken = exact.join(own, "line_id").join(order, "query_id").select(F.array_position("cells", F.col("cell")).cast("int").alias("probes"))
    counts = sorted((r.probes, r["count"]) for r in taken.groupBy("probes").count().collect())  # as many rows as cells
    found, total = 0, sum(n for _, n in counts)
    for probes, n in counts:
        found += n
        if found >= at_least * total:
            return probes
    return 1


def share_read(spark: SparkSession, path: str, queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """One row ``share``: of all pairs of a query and a line, those that a search compares."""
    sizes = spark.read.parquet(path).groupBy("cell").agg(F.count("*").alias("n"))
    asked = nearest_cells(queries.select("query_id", "embedding"), centres, probes).select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("times"))
    met = sizes.join(asked, "cell", "left").agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).alias("met"), F.sum("n").alias("lines"), F.sum("times").alias("asked"))
    return met.select((F.col("met") * probes / (F.col("lines") * F.col("asked"))).alias("share"))
