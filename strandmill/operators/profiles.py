"""Positional profiles, heatmaps and differential peaks."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.regions import each
from strandmill.functions.tails import binomial_q, poisson_sample
from strandmill.operators import overlaps, running, scans


def widened(ref: DataFrame, upstream: int, downstream: int) -> DataFrame:
    """The outer ends moved outwards along the strand."""
    first, last = "i = 0", "i = size(iv) - 1"
    start = f"x.start - CASE WHEN {first} THEN (CASE WHEN x.strand = '+' THEN {upstream} ELSE {downstream} END) ELSE 0 END"
    stop = f"x.stop + CASE WHEN {last} THEN (CASE WHEN x.strand = '+' THEN {downstream} ELSE {upstream} END) ELSE 0 END"
    return ref.withColumn("iv", F.expr(each(start, stop)))


def _binned(signal: DataFrame, ref: DataFrame, upstream: int, downstream: int, bins: int, op: str, stranded: bool, unit: bool, skip_gaps: bool, how: dict) -> DataFrame:
    wide = widened(ref, upstream, downstream)
    o = (overlaps.offset_without_gaps if skip_gaps else overlaps.offset)(signal, wide, op=op, stranded=stranded, **how)
    sizes = wide.selectExpr("region_id AS ref_id", "aggregate(iv, 0L, (s, x) -> s + x.stop - x.start + 1) AS ref_size") if unit else None
    mid = "(start_offset + stop_offset) / 2"
    if unit:
        z, o = f"({mid}) / ref_size", o.join(sizes, "ref_id")
    else:
        z = f"({mid}) / {upstream + downstream}"
    return o.selectExpr("ref_id", f"{z} AS z").where("z >= 0 AND z < 1").selectExpr("ref_id", f"cast(floor({bins} * z) as int) AS bin")


def _edges(width: int, bins: int) -> list[int]:
    """The least doubled offset of each bin, and that behind the last, by the arithmetic of ``_binned``."""
    edges = [0]
    for k in range(1, bins + 1):
        h = max(0, 2 * width * k // bins - 2)
        while h < 2 * width and math.floor(bins * ((h / 2) / width)) < k:
            h += 1
        edges.append(h)
    return edges


def _sites(signal: DataFrame, ref: DataFrame, width: int, bins: int, op: str, stranded: bool) -> tuple[DataFrame, DataFrame]:
    """``ref`` with a site (chrom, strand, the point that bins count from and their direction), and a row for each distinct
    site: n, its regions, and c, the midpoints in each bin.

    Offsets run inwards from an end of a region that is at least as long, so that whatever has its midpoint in a bin
    meets the region: the midpoints between two edges are a difference of running sums, and no pairs are made.
    """
    key = ["chrom", "strand"] if stranded else ["chrom"]
    back = {"1": "false", "5p": "strand = '-'", "3p": "strand = '+'"}[op]
    to = overlaps.flat(ref).selectExpr("region_id", *key, f"{back} AS back", f"CASE WHEN {back} THEN stop ELSE start END AS point")
    mids = overlaps.flat(signal.where("size(iv) = 1")).where("start <= stop").selectExpr(*key, "start + stop AS at", "1L AS d")
    sites = to.groupBy(*key, "back", "point").agg(F.count("*").alias("n"))
    edges = f"array({', '.join(f'{h}L' for h in _edges(width, bins))})"
    asked = sites.select("*", F.posexplode(F.expr(f"transform({edges}, e -> CASE WHEN back THEN 2 * point - e ELSE 2 * point + e - 1 END)")).alias("k", "at"))
    sums = running.running(mids, asked, key).withColumnRenamed("n", "below").drop("area")
    rows = asked.join(sums, [*key, "at"]).groupBy(*key, "back", "point", "n").agg(F.map_from_entries(F.collect_list(F.struct("k", "below"))).alias("m"))  # ``bins`` + 1 entries
    return to, rows.select(*key, "back", "point", "n", F.expr(f"transform(sequence(0, {bins - 1}), b -> abs(m[b + 1] - m[b]))").alias("c"))


def _split(ref: DataFrame, upstream: int, downstream: int, op: str, unit: bool, skip_gaps: bool, how: dict) -> tuple[DataFrame | None, DataFrame | None]:
    """Widened references that ``_sites`` can take, and those (not widened) whose pairs have to be made; None where there are none."""
    if unit or skip_gaps or how or op == "2" or upstream + downstream < 1:
        return None, ref
    plain = F.expr(f"size(iv) = 1 AND iv[0].chrom IS NOT NULL AND iv[0].stop >= iv[0].start - 1 AND iv[0].strand {'IS NOT NULL' if op == '1' else "IN ('+', '-')"}")
    rest = ref.where(~F.coalesce(plain, F.lit(False)))
    return widened(ref.where(plain), upstream, downstream), None if rest.isEmpty() else rest


def profile(signal: DataFrame, ref: DataFrame, *, upstream=1000, downstream=1000, bins=20, op="5p", stranded=True, unit=False, skip_gaps=False, by_refs=True, by_reads=False, by_bin=False, **how) -> DataFrame:
    """bin, value: the midpoints of all signal regions around all references, normalised; every bin has a row."""
    wide, rest = _split(ref, upstream, downstream, op, unit, skip_gaps, how)
    parts = [] if wide is None else [_sites(signal, wide, upstream + downstream, bins, op, stranded)[1].select("n", F.posexplode("c").alias("bin", "c")).selectExpr("bin", "n * c AS n")]
    parts += [] if rest is None else [_binned(signal, rest, upstream, downstream, bins, op, stranded, unit, skip_gaps, how).selectExpr("bin", "1L AS n")]
    n = functools.reduce(DataFrame.union, parts).groupBy("bin").agg(F.sum("n").alias("n"))
    all_bins = signal.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    norm = (ref.count() if by_refs else 1) * (signal.count() if by_reads else 1) * ((1 if unit else upstream + downstream) / bins if by_bin else 1)
    return all_bins.join(n, "bin", "left").select("bin", (F.coalesce("n", F.lit(0)) / F.lit(float(norm or 1))).alias("value"))


def heatmap(signal: DataFrame, ref: DataFrame, *, upstream=1000, downstream=1000, bins=20, smooth=0, op="5p", stranded=True, unit=False, **how) -> DataFrame:
    """region_id, v: a row of bins for each reference region, each the mean of ``smooth`` bins on either side with it."""
    wide, rest = _split(ref, upstream, downstream, op, unit, False, how)
    parts = []
    if wide is not None:
        to, sites = _sites(signal, wide, upstream + downstream, bins, op, stranded)
        parts.append(to.join(sites.drop("n"), [c for c in to.columns if c != "region_id"]).selectExpr("region_id", "transform(c, x -> cast(x as double)) AS v"))
    if rest is not None:
        n = _binned(signal, rest, upstream, downstream, bins, op, stranded, unit, False, how).groupBy("ref_id", "bin").agg(F.count("*").alias("n"))
        rows = n.groupBy("ref_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # ``bins`` entries at most
        met = rest.select("region_id").join(rows, F.col("region_id") == F.col("ref_id"), "left")
        parts.append(met.select("region_id", F.expr(f"transform(sequence(0, {bins - 1}), b -> cast(coalesce(m[b], 0) as double))").alias("v")))
    out = functools.reduce(DataFrame.union, parts)
    if smooth:
        near = f"slice(v, cast(greatest(i - {smooth} + 1, 1) as int), cast(least(i + {smooth}, {bins - 1}) - greatest(i - {smooth}, 0) + 1 as int))"
        out = out.withColumn("v", F.expr(f"transform(v, (y, i) -> aggregate({near}, 0D, (s, x) -> s + x) / size({near}))"))
    return out


def peakdiff_scan(samples: dict[str, list[DataFrame]], genome: DataFrame, *, size=500, step=500, pval=1e-5, stranded=False) -> DataFrame:
    """Windows with counts of the replicates (columns NAME_1, NAME_2), capped at the size, where any is above its background."""
    out, tests = None, []
    for name, replicates in samples.items():
        for i, r in enumerate(replicates[:2], 1):
            c = f"{name}_{i}"
            n = scans.counts(r, genome, size=size, step=step, stranded=stranded).select("chrom", "strand", "k", "start", "stop", F.least("n", F.lit(float(size))).alias(c))
            out = n if out is None else out.join(n, ["chrom", "strand", "k", "start", "stop"], "full")
            tests.append((c, scans.background(r, genome)))
    out = out.fillna(0.0, [c for c, _ in tests])
    keep = F.least(*[binomial_q(F.col(c), F.lit(p), F.lit(float(size + 1))) for c, p in tests], F.lit(1.0))
    return out.where(keep <= pval)


def quantile_normalised(rows: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """Each column's k-th smallest value becomes the mean of all columns' k-th smallest; ties by ids.

    Ranks are counted in tiles of like values, whose sizes are summed first; so no task sorts a whole column.
    """
    long_ = rows.select(*ids, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select(*ids, "e.*")
    long_ = long_.withColumn("tile", F.expr("cast(floor(x * 16) as bigint)"))
    sizes = long_.groupBy("c", "tile").count()
    before = F.sum("count").over(W.partitionBy("c").orderBy("tile")) - F.col("count")
    sizes = sizes.select("c", "tile", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("c", "tile").orderBy("x", *ids))
    ranked = long_.join(sizes, ["c", "tile"]).withColumn("rank", rank + F.col("before"))
    means = ranked.groupBy("rank").agg(F.avg("x").alias("m"))
    out = ranked.join(means, "rank").groupBy(*ids).pivot("c", columns).agg(F.first("m"))
    return out


def peakdiff(scan: DataFrame, a: str, b: str, *, size=500, pseudo=1.0, fdr=0.05, fold=2.0, seed=0) -> DataFrame:
    """score (log2 fold change of b over a after normalisation), outlier, and gain / loss up to a cutoff by the replicates' spread.

    The second replicate of a sample with one is drawn from Poisson distributions with the counts of the first as
    means, by a hash of window and seed.  A window is an outlier where its replicates differ by more
    than three standard deviations of the differences at its level (tiles of the log mean).  Gains and losses
    are scores beyond the least threshold at which replicate-against-replicate scores, as a null, are fewer
    than ``fdr`` of the scores.
    """
    ids = ["chrom", "strand", "k"]
    for i, s in enumerate((a, b)):
        if f"{s}_2" not in scan.columns:
            u = F.expr(f"(pmod(xxhash64(chrom, strand, k, {2 * seed + i}), 1000003) + 0.5) / 1000003").cast("double")
            scan = scan.withColumn(f"{s}_2", F.least(poisson_sample(F.col(f"{s}_1").cast("double"), u), F.lit(float(size))))
    cols = [f"{s}_{i}" for s in (a, b) for i in (1, 2)]
    scaled = scan.select(*ids, *[((F.col(c) + pseudo) / (size + pseudo)).alias(c) for c in cols])
    v = quantile_normalised(scaled, cols, ids)
    one = {s: (f"{s}_1", f"{s}_2") for s in (a, b)}
    mean = {s: (F.col(x) + F.col(y)) / 2 for s, (x, y) in one.items()}
    v = v.withColumns({"score": F.log2(mean[b] / mean[a]), "null": F.log2(F.col(one[b][0]) / F.col(one[b][1])), "own": F.log2(F.col(one[a][0]) / F.col(one[a][1])), "tile": F.floor(F.log2((mean[a] + mean[b]) / 2))})
    spread = v.groupBy("tile").agg(F.stddev_pop("own").alias("sa"), F.stddev_pop("null").alias("sb"))
    v = v.join(spread, "tile").withColumn("outlier", (F.abs("own") > 3 * F.col("sa")) | (F.abs("null") > 3 * F.col("sb")))
    cuts = [i / 10 for i in range(round(10 * math.log2(fold)), 101)]
    sums = v.where("NOT outlier").agg(*[F.sum((F.abs(c) >= t).cast("long")).alias(f"{c}{i}") for i, t in enumerate(cuts) for c in ("score", "null")]).first()
    cut = next((t for i, t in enumerate(cuts) if sums[f"score{i}"] and (sums[f"null{i}"] or 0) <= fdr * sums[f"score{i}"]), None)
    gain, loss = ((F.col("score") >= cut) & ~F.col("outlier"), (F.col("score") <= -cut) & ~F.col("outlier")) if cut is not None else (F.lit(False), F.lit(False))
    return v.select(*ids, "score", "outlier", gain.alias("gain"), loss.alias("loss"))
