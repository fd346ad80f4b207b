"""Connected components by alternating large and small stars.

A round asks for the smallest neighbour of each vertex (summed up before the shuffle)
and joins it to the edges.  Smallest neighbours are written first: so a few are
broadcast by their size, and of many the join's sides are both plain shuffles, of
which adaptive execution can split the one that has a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n): the smallest of each larger end's n smaller neighbours; an end that is missing has none."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each larger neighbour of a vertex is linked to the smallest neighbour, or to the vertex where none is smaller."""
    return edges.join(least.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are linked to the smallest of these."""
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Label each vertex of long pairs (u, v) with the smallest vertex it reaches.

    Returns (vertex, label); a vertex that is the smallest of its component has
    itself as label.  Self-links, repeated and reversed pairs are fine; no edges
    give no rows.  Ends when all edges are stars around their smallest vertex: no
    vertex has two smaller neighbours, or one that has a smaller one itself.
    """
    spark = edges.sparkSession
    made: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        made.append(shared.work_dir(spark, "edges"))
        return shared.write_and_read(df, "edges", made[-1])

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        least = written(_least(now))
        chained = now.join(least.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if not chained.unionByName(least.where("n > 1").select("u")).count():
            shared.free(made[1:])
            break
        large = written(_large_star(now, least))
        now = written(_small_star(large, written(_least(large))))
        shared.free(made[:-1])  # what the round was made from
        made = made[-1:]
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct())
