"""Answers at positions from sums over all that lies before them, or from one sweep: nothing is made for each pair.

Both work in tiles of 65,536 positions; what a tile needs of those before it is one row, or what reaches into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.operators.sets import TILE


def running(events: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """For each distinct ``at`` asked for: n, the sum of ``d`` of all events up to it, and area, that of d * (at - 1)."""
    rows = events.select(*key, "at", "d", F.lit(False).alias("asked")).union(asked.select(*key, "at", F.lit(0).cast("bigint"), F.lit(True)))
    rows = rows.groupBy(*key, "at").agg(F.sum("d").alias("d"), F.max("asked").alias("asked")).selectExpr("*", "d * (at - 1) AS s", f"shiftright(at, {TILE}) AS tile")
    earlier = W.partitionBy(*key).orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    tiles = rows.groupBy(*key, "tile").agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
    tiles = tiles.select(*key, "tile", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "ds"])
    inside = W.partitionBy(*key, "tile").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    sums = rows.select(*key, "tile", "at", "asked", F.sum("d").over(inside).alias("n"), F.sum("s").over(inside).alias("area")).where("asked")
    return sums.join(tiles, [*key, "tile"]).select(*key, "at", (F.col("n") + F.col("d0")).alias("n"), (F.col("area") + F.col("s0")).alias("area"))


def _latest(lo, hi, at):
    """Distance of each of ``at`` from the greatest of ``lo`` whose lo..hi holds it, or None; lo and at ascend."""
    found, open_, i = [], [], 0
    for p in at:
        while i < len(lo) and lo[i] <= p:
            open_.append(i)
            i += 1
        while open_ and hi[open_[-1]] < p:
            open_.pop()
        found.append(p - lo[open_[-1]] if open_ else None)
    return found


def nearest(points: DataFrame, refs: DataFrame) -> DataFrame:
    """chrom, p, d5, d3: how far the nearest 5' and 3' end lies of those regions (chrom, strand + or -, start, stop) that hold p.

    Starts are looked for upwards, stops downwards with the signs of all positions changed.  Of regions with one
    start only the longest counts; of those that reach into a tile, for each end there, the one that starts last.
    """
    import pandas as pd

    ways = "inline(array(named_struct('way', 1, {0}), named_struct('way', -1, {1})))"
    at = points.select("chrom", "p").distinct().selectExpr("chrom", ways.format("'at', p", "'at', -p")).withColumn("tile", F.shiftright("at", TILE))
    sides = refs.selectExpr("chrom", "strand", ways.format("'lo', start, 'hi', stop", "'lo', -stop, 'hi', -start"))
    sides = sides.groupBy("chrom", "strand", "way", "lo").agg(F.max("hi").alias("hi"))
    held = sides.select("*", F.explode(F.expr(f"sequence(shiftright(lo, {TILE}), shiftright(hi, {TILE}))")).alias("tile"))
    held = held.withColumns({"hi": F.expr(f"least(hi, shiftleft(tile + 1, {TILE}) - 1)"), "into": F.expr(f"lo < shiftleft(tile, {TILE})")})
    held = held.groupBy("chrom", "way", "tile", "strand", "into", F.expr("CASE WHEN into THEN hi ELSE lo END")).agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")).select("chrom", "way", "tile", "strand", "lo", "hi")

    def sweep(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        p, r = p.sort_values("at")[["chrom", "way", "at"]], r.sort_values("lo")
        for name, strand in (("plus", "+"), ("minus", "-")):
            s = r[r["strand"] == strand]
            p[name] = pd.array(_latest(s["lo"].tolist(), s["hi"].tolist(), p["at"].tolist()), dtype="Int64")
        return p

    key = ["chrom", "way", "tile"]
    found = at.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(sweep, "chrom string, way int, at long, plus long, minus long")
    up = "CASE WHEN way = 1 THEN {0} ELSE {1} END".format
    return found.groupBy("chrom", F.expr("way * at").alias("p")).agg(F.min(F.expr(up("plus", "minus"))).alias("d5"), F.min(F.expr(up("minus", "plus"))).alias("d3")).where("d5 IS NOT NULL OR d3 IS NOT NULL")
