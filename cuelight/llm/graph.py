"""Connected components of an edge table, by alternating star operations.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each
round is two grouped minima (combined before the shuffle) and two joins on the
node id; a hub's edges sit on the side of the join that adaptive execution
splits, so no task holds all edges of a node. Rounds are cut with checkpoints,
and tables of few rows are gathered into few partitions, as a round writes a file for each of them
at every shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import stable


#: Rows of a partition, about, where there would be less.
ROWS = 100_000


def _gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as its rows fill, if these are fewer than a shuffle makes."""
    parts = 1 + rows // ROWS
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``edges(a, b)`` of any orderable type to ``(node, component)``.

    ``component`` is the smallest node reachable. Self loops, repeated edges and
    nulls are ignored; nodes without an edge are not in the result.
    """
    links = stable(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = None
    n = links.count()
    for _ in range(max_rounds):
        links = _gathered(links, n)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _gathered(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), n)
        large = _gathered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), n)
        least = _gathered(large.groupBy("a").agg(F.min("b").alias("m")), n)
        small = (
            large.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        links = stable(_gathered(small, n))
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        seen, n = state, state["n"]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )
