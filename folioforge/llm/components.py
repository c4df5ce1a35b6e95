"""Connected components of a table of links, by alternating large and small stars.

Each round replaces links by links to the least neighbour; every node ends linked to its component's
least node. Rounds are logarithmic in practice. All steps are joins and map-side combined
minima on tables no longer than the links; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, durable


def _to_least(directed: DataFrame) -> DataFrame:
    """directed (u, v) with least: the least of u and its neighbours."""
    least = directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    return directed.join(least, "u")


def _round(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
    # Now v < u in every row.
    starred = _to_least(large)
    small = starred.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(starred.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
    return small.select(F.col("v").alias("a"), F.col("u").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link to another; links: (a, b) in either order."""
    mark = [F.count("*"), F.bit_xor(F.xxhash64("a", "b"))]
    current = durable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = tuple(current.agg(*mark).first())
    while before[0]:
        older, current = current, durable(_round(current), "links")
        drop(older)
        now = tuple(current.agg(*mark).first())
        if now == before:
            break
        before = now
    out = current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    out.folio_path = current.folio_path
    return out
