"""Connected components by alternating large-star and small-star.

Edges stay distributed: every step is a minimum per vertex (combined before the shuffle) and a join
back; the edges of a vertex with very many neighbours meet its minimum in a join that is split by size
(adaptive skew join), never in an array. Each round is written to
the shared folder, which cuts its lineage; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selvedge.session import stage


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller vertex; loops go."""
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _downward(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _downward(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``edges`` (u, v) to (u, v): every vertex that is not the least of its component, and that least vertex."""
    stars = stage(_downward(edges), label)
    mark, before = _mark(stars), None
    while mark != before and mark[0]:
        stars = stage(_small_star(_large_star(stars)), label)
        mark, before = _mark(stars), mark
    return stars
