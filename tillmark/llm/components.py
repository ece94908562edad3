"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillmark.llm.storage import stored


def _minimum(edges: DataFrame) -> DataFrame:
    """Per ``u`` the smallest id among itself and its neighbours; combined map-side."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_minimum(both), "u")
        .where("v > u and v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    lows = _minimum(edges)
    near = edges.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = lows.where("u <> m").select("u", F.col("m").alias("v"))
    return near.union(own).distinct()


def connected_components(links: DataFrame, name: str) -> DataFrame:
    """``node, component`` for the ends of ``links`` (long columns ``a``, ``b``).

    Alternating large-star and small-star steps; each round is written down, and
    joins leave hot centres to adaptive skew splitting.  The component is the
    smallest node.  Missing ends and loops are ignored.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        name,
    )
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges = stored(_small_star(_large_star(edges)), name)
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(edges.select("v", "v").distinct())
