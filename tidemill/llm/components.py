"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, and outlives any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (a long, b long); component is its smallest node.

    Each round maps every node to the least of itself and its neighbours and replaces links by links of
    their images, so hubs fold in one round and the table of links shrinks; rounds are logarithmic for
    the star-like groups of copies. Minima are taken before the shuffle, so a hub is no hot group.
    """
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")), "up")
        steps.append(up)
        left = edges.join(up, edges.a == up.node).select(F.col("up").alias("a"), "b")
        moved = left.join(up, left.b == up.node).select("a", F.col("up").alias("b")).filter("a <> b")
        edges = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # From the last round back: the image of an image is known before the image is asked for it.
    final = steps[-1].select("node", F.col("up").alias("component"))
    for up in reversed(steps[:-1]):
        later = final.select(F.col("node").alias("up"), "component")
        final = up.join(later, "up", "left").select("node", F.coalesce("component", "up").alias("component"))
    return stored(final, "components")
