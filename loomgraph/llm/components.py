"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise


def _pairs(*pairs: tuple[str, str]) -> Column:
    """One row (u, v) for each of the pairs, without reading the edges once for each."""
    return F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs]))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of it and its neighbours: as many edges as before, which lead down."""
    both = edges.select(_pairs(("u", "v"), ("v", "u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges lead from a larger u to a smaller v; u and its smaller neighbours all go to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(_pairs(("u", "m"), ("v", "m"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each u has one v, which leads nowhere: then every component is one star around its least id."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("to")), F.struct(F.col("v").alias("id"), F.lit(None).cast("long").alias("to")))))
    at = ends.groupBy("id").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max(F.col("to").isNull()).alias("root"))
    return at.where("lo < hi or (lo is not null and root)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs, best of a stored table -> (id, component): each id that has an edge, with the least id it reaches.

    Links stay in tables: each round is two joins and aggregates whose hot keys combine before the
    shuffle, and its result is written, so lineage doesn't grow. The number of rounds grows with the
    logarithm of the longest path. A star per component ends them, which one aggregate can tell.
    """
    cur = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    while True:
        cur = materialise(_small_star(_large_star(cur)), "star")
        if _settled(cur):
            break
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
