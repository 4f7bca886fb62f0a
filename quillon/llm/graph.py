"""Connected components over a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import dropped, hot_join, stored


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star pass (Kiveris et al., 2014) as joins on minima.

    Neighbour lists are never gathered: a node only learns the minimum of its neighbours,
    which Spark combines before the shuffle, so a hub costs one row per map task, and its
    links are dealt over several tasks where they learn its minimum.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # A larger neighbour now points to the minimum around u.
    large = hot_join(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = stored(large.where("u > v").distinct(), "large")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = hot_join(large, least, "u", "v").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): every node of `edges` with the smallest node it is connected to.

    Null ends and self links are ignored; repeated links and either direction do no harm.
    An empty table gives an empty table. Each round is written to the shared folder, so a
    lost executor costs a task, not the rounds before.
    """
    now = stored(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    state = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            break
        state, before = new, now
        now = stored(_star_round(before), "links")
        dropped(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
