"""Whole-set operations on single-interval regions: flat columns region_id, label, chrom, strand, start, stop inside.

Windows run by tiles of chromosome (and strand): what a tile needs of those before or behind it is one row for each
tile, so that work spreads over as many tasks as there are tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.regions import each
from strandmill.operators.interval_join import flat, interval_join


def gsort(df: DataFrame, *, by_strand=True) -> DataFrame:
    """By chromosome, strand, start, and the longer first."""
    keys = ["iv[0].chrom", *(["iv[0].strand"] if by_strand else []), "iv[0].start"]
    return df.orderBy(*map(F.expr, keys), F.expr("element_at(iv, -1).stop").desc())


def _single(df: DataFrame) -> DataFrame:
    return flat(df.where("size(iv) = 1")).drop("iv")


def _regions(df: DataFrame) -> DataFrame:
    return df.withColumn("iv", F.expr("array(named_struct('chrom', chrom, 'strand', strand, 'start', start, 'stop', stop))")).drop("chrom", "strand", "start", "stop")


def _key(by_strand: bool) -> list[str]:
    return ["chrom", "strand"] if by_strand else ["chrom"]


#: Positions in a tile, as a power of two; a chromosome has a few thousand tiles.
TILE = 16


def _neighbour(rows: DataFrame, key: list[str], order: list, values: list[str], name: str, *, ahead: bool = False) -> DataFrame:
    """With ``name``: ``values`` (a struct) of the row before, or ``ahead`` of the row behind, by ``order``, which starts with ``tile``'s column."""
    at, pick = [*key, "tile"], F.struct(*values)
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    inside = rows.withColumn(name, step(pick).over(W.partitionBy(*at).orderBy(*order)))
    ends = rows.groupBy(*at).agg(edge(pick, F.struct(*order)).alias("end"))
    ends = ends.select(*at, step("end").over(W.partitionBy(*key).orderBy("tile")).alias("end"))
    return inside.join(ends, at).withColumn(name, F.coalesce(name, "end")).drop("end")


def _tiled(rows: DataFrame, at: str = "start") -> DataFrame:
    return rows.withColumn("tile", F.shiftright(at, TILE))


def _runs(rows: DataFrame, key: list[str], distance: int) -> DataFrame:
    """With ``run``: equal, within a key, for rows that link."""
    rows, tile = _tiled(rows), [*key, "tile"]
    earlier = W.partitionBy(*key).orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    order = W.partitionBy(*tile).orderBy("start", "stop", "region_id")
    tops = rows.groupBy(*tile).agg(F.max("stop").alias("top")).select(*tile, F.max("top").over(earlier).alias("top"))
    reach = F.greatest(F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), "top")
    runs = rows.join(tops, tile).withColumn("new", F.when(F.col("start") - reach <= distance, 0).otherwise(1))
    begun = runs.groupBy(*tile).agg(F.sum("new").alias("begun")).select(*tile, F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("begun"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).join(begun, tile)
    return runs.withColumn("run", F.col("run") + F.col("begun")).drop("tile", "top", "new", "begun")


def link(df: DataFrame, *, distance=0, by_strand=True, label=None, delimiter=",") -> DataFrame:
    """Runs of regions whose start is at most ``distance`` after the greatest stop before; label: None, min, max, sum or join."""
    key = _key(by_strand)
    runs = _runs(_single(df), key, distance)
    number = F.coalesce(F.col("label").try_cast("double"), F.lit(0.0))
    name = {None: F.lit("_"), "min": F.min(number).cast("string"), "max": F.max(number).cast("string"), "sum": F.sum(number).cast("string")}.get(label)
    if label == "join":
        name = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "stop", "region_id", "label"))), lambda x: x["label"]), delimiter)
    out = runs.groupBy(*key, "run").agg(F.min("region_id").alias("region_id"), name.alias("label"), F.min("start").alias("start"), F.max("stop").alias("stop"), *([] if by_strand else [F.min_by("strand", F.struct("start", "stop", "region_id")).alias("strand")]))
    return _regions(out.select("region_id", "label", "chrom", "strand", "start", "stop"))


def inv(df: DataFrame, genome: DataFrame, *, compat=False) -> DataFrame:
    """What no region covers, by chromosome and strand with regions; ``compat`` loses a last gap of one position."""
    key, merged = ["chrom", "strand"], _tiled(flat(link(df)).drop("iv"))
    behind = merged.groupBy(*key).agg(F.max("stop").alias("final")).join(F.broadcast(genome), "chrom")  # a row for each chromosome and strand
    gaps = _neighbour(merged, key, ["start"], ["stop"], "before").join(F.broadcast(behind), key)
    gaps = gaps.withColumns({"from": F.coalesce("before.stop", F.lit(0)) + 1, "to": F.col("start") - 1, "last": F.col("stop") == F.col("final")})
    tail = "length - stop > 1" if compat else "length > stop"
    both = F.expr(f"concat(array(struct(from AS start, least(to, length) AS stop)), CASE WHEN last AND {tail} THEN array(struct(stop + 1 AS start, length AS stop)) ELSE array() END)")
    out = gaps.select("chrom", "strand", F.explode(both).alias("g")).select("chrom", "strand", "g.*").where("start <= stop")
    return _regions(out.select(F.xxhash64("chrom", "strand", "start").alias("region_id"), F.lit("_").alias("label"), "chrom", "strand", "start", "stop"))


def gdist(df: DataFrame, *, op1="1", op2="1") -> DataFrame:
    """Distance of each region from the one before, in order; NaN where chromosome or strand changes.

    The first row of a chromosome and strand takes its predecessor from the groups' ends.
    """
    at = {"1": "start", "2": "stop", "5p": "CASE WHEN strand = '+' THEN start ELSE stop END", "3p": "CASE WHEN strand = '+' THEN stop ELSE start END"}
    rows = _tiled(_single(df)).selectExpr("*", f"{at[op1]} AS p1", f"{at[op2]} AS p2", "-stop AS down")
    key, order = ["chrom", "strand"], ["start", "down", "region_id"]
    rows = _neighbour(rows, key, order, ["p1", "region_id"], "before")
    ends = rows.groupBy(*key).agg(F.max_by("region_id", F.struct(*order)).alias("end_id"))
    ends = ends.withColumn("prev_end", F.lag("end_id").over(W.orderBy("chrom", "strand")))  # a row for each chromosome and strand
    out = rows.join(F.broadcast(ends.select(*key, "prev_end")), key)
    out = out.select(F.coalesce("before.region_id", "prev_end").alias("prev_id"), "region_id", F.when(F.col("before").isNotNull(), (F.col("p2") - F.col("before.p1")).cast("double")).otherwise(F.lit(float("nan"))).alias("distance"))
    return out.where("prev_id IS NOT NULL")


def test(df: DataFrame, *, by_strand=True) -> DataFrame:
    """Against the predecessor in the order of region_id: rows out of order, included in it, overlapping it."""
    key = "struct(chrom, strand, start)" if by_strand else "struct(chrom, start)"
    rows = _single(df).selectExpr("region_id", "chrom", "strand", "start", "stop", f"{key} AS k", "region_id div 4096 AS tile")
    order = W.partitionBy("tile").orderBy("region_id")
    cols = ["k", "chrom", "strand", "start", "stop"]
    inner = rows.withColumns({f"p_{c}": F.lag(c).over(order) for c in cols})
    ends = rows.groupBy("tile").agg(F.max_by(F.struct(*cols), "region_id").alias("e"))
    heads = inner.groupBy("tile").agg(F.min_by(F.struct(*cols), "region_id").alias("h"))
    seams = ends.join(heads, "tile").withColumn("p", F.lag("e").over(W.orderBy("tile"))).where("p IS NOT NULL").select("h", "p")
    met = inner.where("p_k IS NOT NULL").select(F.struct(*cols).alias("h"), F.struct(*[F.col(f"p_{c}").alias(c) for c in cols]).alias("p")).union(seams)
    same = "h.chrom = p.chrom" + (" AND h.strand = p.strand" if by_strand else "")
    flags = met.selectExpr("h.k < p.k AS bad", f"{same} AND h.start >= p.start AND h.stop <= p.stop AS inside", f"{same} AND h.start <= p.stop AND h.stop >= p.start AS meets")
    return flags.agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(n) for c, n in (("bad", "unsorted"), ("inside", "inclusions"), ("meets", "overlaps"))])


def annotator(df: DataFrame, upstream_max: int, upstream_min: int = 0, *, stranded=True, bits=None) -> DataFrame:
    """The upstream flank of each region, ``upstream:LABEL``, trimmed at other flanks of its strand, not below the least size."""
    flank = "CASE WHEN x.strand = '+' THEN {0} ELSE {1} END".format
    f = df.where("size(iv) = 1").withColumn("iv", F.expr(each(flank(f"greatest(x.start - {upstream_max}, 1)", "x.stop + 1"), flank("x.start - 1", f"x.stop + {upstream_max}"))))
    f = f.where("iv[0].start <= iv[0].stop").withColumn("label", F.concat(F.lit("upstream:"), "label")).select("region_id", "label", "iv")
    met = interval_join(f, f, stranded=True, bits=bits).where("t.region_id <> r.region_id AND ((t.strand = '+' AND r.stop < t.stop) OR (t.strand = '-' AND r.start > t.start))")
    edge = met.groupBy(F.col("t.region_id").alias("region_id")).agg(F.max("r.stop").alias("hi"), F.min("r.start").alias("lo"))
    out = flat(f).drop("iv").join(edge, "region_id", "left")
    m = upstream_min
    start = f"CASE WHEN strand = '-' OR hi IS NULL THEN start WHEN stop - (hi + 1) + 1 < {m} THEN greatest(1, stop - {m} + 1) ELSE hi + 1 END"
    stop = f"CASE WHEN strand = '+' OR lo IS NULL THEN stop WHEN (lo - 1) - start + 1 < {m} THEN start + {m} - 1 ELSE lo - 1 END"
    return _regions(out.selectExpr("region_id", "label", "chrom", "strand", f"{start} AS start", f"{stop} AS stop").where("start <= stop"))


def bedgraph(df: DataFrame) -> DataFrame:
    """Forward regions as chrom, start, start, label."""
    return _single(df).where("strand = '+'").selectExpr("region_id", "chrom", "start", "start AS stop", "label")


def partition(df: DataFrame, *, by_strand=True, delimiter=",", bits=None) -> DataFrame:
    """Disjoint pieces between all ends of regions, with the labels of those that cover each."""
    rows, key = _single(df), ["chrom", "strand"]
    cuts = rows.selectExpr("chrom", "strand", "explode(array(start, stop + 1)) AS at").distinct()
    pieces = _neighbour(_tiled(cuts, "at"), key, ["at"], ["at"], "behind", ahead=True)
    pieces = pieces.withColumn("stop", F.col("behind.at") - 1).where("stop IS NOT NULL")
    pieces = _regions(pieces.select(F.xxhash64("chrom", "strand", "at").alias("region_id"), F.lit("_").alias("label"), "chrom", "strand", F.col("at").alias("start"), "stop"))
    met = interval_join(df.where("size(iv) = 1"), pieces, bits=bits)
    names = F.array_join(F.sort_array(F.collect_list("t.label")), delimiter)
    return met.groupBy(F.col("r.region_id").alias("region_id"), F.col("r.iv").alias("iv")).agg(names.alias("label")).select("region_id", "label", "iv")


def rev(df: DataFrame) -> DataFrame:
    """Regions in order, those of '-' backwards."""
    return df.orderBy(F.expr("iv[0].chrom"), F.expr("iv[0].strand"), F.expr("CASE WHEN iv[0].strand = '-' THEN -iv[0].start ELSE iv[0].start END"), "region_id")


def cluster(df: DataFrame) -> DataFrame:
    """Regions that overlap no earlier representative, by start: the greedy choice, run by run of overlapping regions."""

    def greedy(pdf):
        out, last = [], None
        for r in pdf.sort_values(["start", "stop", "region_id"]).itertuples():
            if last is None or r.start > last:
                out.append(r.region_id)
                last = r.stop
        return pdf[pdf["region_id"].isin(out)][["region_id"]]

    runs = _runs(_single(df), ["chrom", "strand"], 0).select("region_id", "chrom", "strand", "start", "stop", "run")
    chosen = runs.groupBy("chrom", "strand", "run").applyInPandas(greedy, "region_id long")
    return df.join(chosen, "region_id", "left_semi")
