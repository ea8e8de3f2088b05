"""Connected components by alternating star operations; nothing but sums comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that links reach) for all nodes of ``edges`` (a, b); self-links are ignored.

    Each round points a node's larger neighbours, then its smaller ones, at the smallest node around it; both
    keep what is connected connected.  When the edges are stars, whose centres are no other star's leaves, the
    stars are the components.  Each round is written to the shared folder.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        inner = e.select(F.col("b").alias("a")).distinct().join(e.select("a"), "a", "left_semi")
        state = e.agg(F.count("*").alias("n"), F.count_distinct("a").alias("leaves")).first()
        if state["n"] == state["leaves"] and inner.isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = saved(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
