"""Contact pairs: filtering by fragments, duplicates, binning.

Reads: read_id, mate (0 or 1, in input order), chrom ('*' if unmapped), strand, start, stop, multi (several hits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.operators.interval_join import flat

#: Positions in a bin of the search for the fragment that holds a point.
POINT_BITS = 14


def first_mapped(attempts: DataFrame) -> DataFrame:
    """Of alignments of ever shorter reads (read_id, length, chrom, ...), the longest mapped one, or the shortest."""
    order = W.partitionBy("read_id").orderBy((F.col("chrom") == "*").cast("int"), F.when(F.col("chrom") == "*", F.col("length")).otherwise(-F.col("length")))
    return attempts.withColumn("nr", F.row_number().over(order)).where("nr = 1").drop("nr")


def classify(reads: DataFrame, fragments: DataFrame, *, min_distance=1000, max_offset=500, filter_self=True, compat=False) -> DataFrame:
    """read_id, class, a, b (5' points of both mates).

    Classes: unpaired, unmapped, multihit, no-fragment, same-fragment, small-distance, proximal, distal, single,
    unmapped-multihit.  Small distance asks for one chromosome, unless ``compat``; without ``filter_self`` pairs
    of one fragment are classed by their distances.
    """
    end = "CASE WHEN strand = '+' THEN start ELSE stop END"
    pts = reads.selectExpr("read_id", "mate", "chrom", "strand", f"{end} AS p", "multi")
    f = flat(fragments).selectExpr("region_id AS frag", "chrom", "start AS f0", "stop AS f1")
    bins = f.select("*", F.explode(F.expr(f"sequence(shiftright(f0, {POINT_BITS}), shiftright(f1, {POINT_BITS}))")).alias("bin"))
    held = pts.withColumn("bin", F.expr(f"shiftright(p, {POINT_BITS})")).join(bins, ["chrom", "bin"], "left")
    inside = F.expr("CASE WHEN p BETWEEN f0 AND f1 THEN struct(frag, least(abs(f0 - p), abs(f1 - p)) AS off) END")
    held = held.groupBy("read_id", "mate", "chrom", "strand", "p", "multi").agg(F.min(inside).alias("f"))
    mate = F.struct("chrom", "strand", "p", "multi", "f")
    pairs = held.groupBy("read_id").agg(F.max(F.when(F.col("mate") == 0, mate)).alias("a"), F.max(F.when(F.col("mate") == 1, mate)).alias("b"))
    near = "a.strand <> b.strand AND abs(a.p - b.p) < {}".format(min_distance) + ("" if compat else " AND a.chrom = b.chrom")
    kind = F.expr(f"""CASE WHEN a IS NULL OR b IS NULL THEN 'unpaired' WHEN a.chrom = '*' AND b.chrom = '*' THEN 'unmapped'
        WHEN a.multi AND b.multi THEN 'multihit'
        WHEN a.chrom <> '*' AND b.chrom <> '*' AND NOT a.multi AND NOT b.multi THEN CASE
            WHEN a.f IS NULL OR b.f IS NULL THEN 'no-fragment' WHEN {str(filter_self).lower()} AND a.f.frag = b.f.frag THEN 'same-fragment' WHEN {near} THEN 'small-distance'
            WHEN a.f.off <= {max_offset} AND b.f.off <= {max_offset} THEN 'proximal' ELSE 'distal' END
        WHEN a.chrom <> '*' OR b.chrom <> '*' THEN 'single' ELSE 'unmapped-multihit' END""")
    return pairs.select("read_id", kind.alias("class"), "a", "b")


def proximal_pairs(classified: DataFrame) -> DataFrame:
    """Pair regions of the 5' points of proximal pairs: region_id, label, iv of two."""
    point = "named_struct('chrom', {0}.chrom, 'strand', {0}.strand, 'start', {0}.p, 'stop', {0}.p)".format
    return classified.where("class = 'proximal'").selectExpr("read_id AS region_id", "cast(read_id as string) AS label", f"array({point('a')}, {point('b')}) AS iv")


def dedup(pairs: DataFrame) -> DataFrame:
    """Of pairs with the same two chromosomes, strands and positions, the first by region_id; copies meet in map-side sums."""
    key = [F.expr(f"iv[{k}].{c}").alias(f"{c}{k}") for k in (0, 1) for c in ("chrom", "strand", "start")]
    stay = pairs.select("region_id", *key).groupBy(*[f"{c}{k}" for k in (0, 1) for c in ("chrom", "strand", "start")]).agg(F.min("region_id").alias("region_id"))
    return pairs.join(stay.select("region_id"), "region_id", "left_semi")


def bin_pairs(pairs: DataFrame, size: int, genome: DataFrame | None = None, *, compat=False, matrix=False) -> DataFrame:
    """Bins of both ends, from 1: (start - 1) div size + 1, or with ``compat`` start div size + 1; over all chromosomes with ``genome``.

    ``matrix``: counts of both orders (bin_a, bin_b, n) instead of a row for each pair.
    """
    at = "iv[{0}].start div {1} + 1" if compat else "(iv[{0}].start - 1) div {1} + 1"
    out = pairs.selectExpr("region_id", "iv[0].chrom AS chrom_a", "iv[1].chrom AS chrom_b", f"{at.format(0, size)} AS bin_a", f"{at.format(1, size)} AS bin_b")
    if genome is not None:
        n = F.expr(f"length div {size} + 1")
        base = genome.select("chrom", (F.sum(n).over(W.orderBy("chrom")) - n).alias("base"))  # a row for each chromosome
        for s in "ab":
            out = out.join(F.broadcast(base.select(F.col("chrom").alias(f"chrom_{s}"), F.col("base").alias(f"base_{s}"))), f"chrom_{s}").withColumn(f"bin_{s}", F.col(f"bin_{s}") + F.col(f"base_{s}")).drop(f"base_{s}")
    if not matrix:
        return out.select("region_id", "chrom_a", "chrom_b", "bin_a", "bin_b")
    key = [] if genome is not None else ["chrom_a", "chrom_b"]
    other = out.where("bin_a <> bin_b OR chrom_a <> chrom_b").select(F.col("bin_b").alias("bin_a"), F.col("bin_a").alias("bin_b"), F.col("chrom_b").alias("chrom_a"), F.col("chrom_a").alias("chrom_b"))
    return out.select("bin_a", "bin_b", "chrom_a", "chrom_b").unionByName(other).groupBy(*key, "bin_a", "bin_b").agg(F.count("*").alias("n"))
