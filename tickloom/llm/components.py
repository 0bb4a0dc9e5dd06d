"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import discard, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return row["n"], int(row["s"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs to (id, component_id), the smallest id reachable; a row for each id that has an edge to another.

    Each round is one large-star and one small-star step, kept in the shared folder, so its plan does not grow and lost
    executors cost one round at most. The number of rounds grows with the logarithm of the longest path.
    """
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        then, now = now, stored(small.distinct(), "edges")
        discard(then)
        before, state = state, _state(now)
        if state == before:
            break
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component_id")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
