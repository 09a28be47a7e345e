"""Connected components of links by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.storage import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `comp` (the smallest node it reaches) for every node with a link.

    Every round points all neighbours of a node at the smallest among them; links stay
    linear in number and become stars. Rounds are written to the shared folder.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges, "links")
    before = None
    while True:
        # Larger neighbours of each node go to the smallest of all its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # Smaller neighbours and the node itself go to the smallest of them.
        large = stored(large, "links")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        edges = stored(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v"))).distinct(),
            "links",
        )
        # Only stars are left when another round changes nothing.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
        before = state
