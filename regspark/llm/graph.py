"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before its shuffle) and a join back, so a
vertex with very many links is never gathered in one task. Steps are stored under
``spark.checkpoint.dir``; the number of rounds grows with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import discard, store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links (a, b), a > b, hung on the smallest neighbour; large: of all, small: of the smaller ones."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    low = low.select("a", F.least("a", "m").alias("m"))
    hung = both.join(low, "a")
    if large:
        out = hung.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = (hung.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(low.select("a", F.col("m").alias("b"))))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root): the smallest vertex reachable, for every vertex that has a link."""
    edges = store(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                  .filter("a <> b").distinct(), "links")

    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = state(edges)
    while now[0]:
        after = store(_star(_star(edges, True), False), "links")
        discard(edges)
        edges, before, now = after, now, state(after)
        if before == now:
            break
    return (edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
            .unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()))
