"""Connected components by alternating large-star and small-star steps.

Every step is two aggregations and joins over the edges; each round is written to
the shared folder. Neither edges nor labels reach the driver, only two numbers per
round that tell whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordloom.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns a and b; the result has node and component (the smallest node), for nodes with an edge."""
    ordered = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, known = saved(ordered.distinct(), "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == known or not state[0]:
            break
        now, known = saved(_small_star(_large_star(now).distinct()).distinct(), "edges"), state
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("v", "v"))
