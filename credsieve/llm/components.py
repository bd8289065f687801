"""Connected components of an undirected graph of long ids by alternating stars.

Every round has two steps.  The large star hangs the larger neighbours of a node under its
smallest neighbour, the small star the smaller ones; the edges end as stars around the
smallest node of each component, after a number of rounds logarithmic in the diameter.
Minima are combined before the shuffle and a node's edges are never gathered in one
place, so hubs need no special care.  Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.storage import Steps


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` has u > v in every row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))
    ).first()
    return tuple(row)


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); component is the smallest node.

    Repeated edges and loops are allowed; nodes without an edge to another one are absent.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = steps.write(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        after = steps.write(_small_star(_large_star(now)))
        steps.drop(now)
        before, now, mark = mark, after, _mark(after)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
