"""Connected components of a table of links, by alternating large and small stars.

Each round is two joins and two minima over the links. Minima combine before they are shuffled and the joins broadcast the
smallest neighbours of hubs, so no component and no hub, however large, is gathered in a task. Every round's links are a
table in the shared folder, so lineage stays short; rounds go on until the links stand still.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, join_hot, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = stored(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = stored(join_hot(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
    drop(both)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "down")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = stored(join_hot(down, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
    drop(down)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another; component is the smallest node that links reach."""
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        large = _large_star(edges)
        before, edges = edges, _small_star(large)
        drop(before, large)
        # all nodes but the centres hang on a smaller one; once the table stands still they hang on the smallest
        now = edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
        if now == state:
            centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(centres)
        state = now
