"""Consumers of the interval join: test regions against reference regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.regions import SPAN, TOTAL, each, point, weight
from strandmill.operators import running, sets
from strandmill.operators.interval_join import flat, interval_join


def overlap(test, ref, *, label=False, **how):
    """Every test region once for each reference region that it meets."""
    name = "concat(t.label, ':', r.label)" if label else "t.label"
    return interval_join(test, ref, **how).selectExpr("t.region_id", f"{name} AS label", "t.iv", "r.region_id AS ref_id")


def subset(test, ref, *, inverse=False, **how):
    """Test regions that meet a reference region, or those that meet none."""
    ids = interval_join(test, ref, **how).selectExpr("t.region_id").distinct()
    return test.join(ids, "region_id", "left_anti" if inverse else "left_semi")


def intersect(test, ref, *, label=False, **how):
    """For every pair the test intervals, clipped to the reference region's envelope."""
    name = "concat(t.label, ':', r.label)" if label else "t.label"
    clip = f"filter({each('greatest(x.start, r.start)', 'least(x.stop, r.stop)', over='t.iv')}, x -> x.start <= x.stop)"
    # What is left of a single interval isn't empty, as it meets the envelope; no function over arrays is called for it.
    one = "array(named_struct('chrom', t.chrom, 'strand', t.strand, 'start', greatest(t.start, r.start), 'stop', least(t.stop, r.stop)))"
    met = interval_join(test, ref, **how).where(f"t.one OR size({clip}) > 0")
    return met.selectExpr("t.region_id", f"{name} AS label", "r.region_id AS ref_id", f"CASE WHEN t.one THEN {one} ELSE {clip} END AS iv")


def _per_ref(ref: DataFrame, values: DataFrame, name: str, least: float) -> DataFrame:
    out = ref.join(values, "region_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out.where(F.col(name) >= least) if least > 0 else out


def count(test, ref, *, least=0, max_label_value=1.0, **how):
    """The weights of the test regions that meet each reference region; zero rows stay unless ``least`` is above 0."""
    met = interval_join(test, ref, **how).select(F.col("r.region_id").alias("region_id"), weight(F.col("t.label"), max_label_value).alias("w"))
    return _per_ref(ref, met.groupBy("region_id").agg(F.sum("w").alias("hits")), "hits", least)


_FLAT = "greatest(0, least(t.stop, r.stop) - greatest(t.start, r.start) + 1)"
_BASES = f"CASE WHEN t.one AND r.one THEN {_FLAT} ELSE aggregate(t.iv, 0L, (a, x) -> a + aggregate(r.iv, 0L, (b, y) -> b + greatest(0, least(x.stop, y.stop) - greatest(x.start, y.start) + 1))) END"


def coverage(test, ref, *, least=0, max_label_value=1.0, **how):
    """Bases of each reference region under test intervals, times their weights."""
    bases = F.expr(_FLAT if how.get("gaps") else _BASES)
    met = interval_join(test, ref, **how).select(F.col("r.region_id").alias("region_id"), (bases * weight(F.col("t.label"), max_label_value)).alias("w"))
    return _per_ref(ref, met.groupBy("region_id").agg(F.sum("w").alias("bases")), "bases", least)


def density(test, ref, *, least=0.0, max_label_value=1.0, **how):
    """Coverage over the region's size, with its gaps where they count."""
    out = coverage(test, ref, max_label_value=max_label_value, **how)
    out = out.withColumn("density", F.expr(f"try_divide(bases, {SPAN if how.get('gaps') else TOTAL})")).drop("bases")
    return out.where(F.col("density") >= least) if least > 0 else out


def rpkm(test, ref, *, least=0.0, max_label_value=1.0, compat=False, **how):
    """Hits per thousand bases and million hits in all; ``compat`` leaves ``least`` without effect."""
    hits = count(test, ref, max_label_value=max_label_value, **how)
    total = hits.agg(F.sum("hits").alias("total"))
    out = hits.join(F.broadcast(total)).withColumn("rpkm", F.expr(f"try_divide(1000 * hits, {TOTAL} * (total / 1e6))"))
    return (out if compat or least <= 0 else out.where(F.col("hits") >= least)).drop("total", "hits")


def _offsets(op: str, strand: str) -> tuple[str, str]:
    """SQL of the start and stop offset of q from the reference point, along ``strand``."""
    at = {"1": "r.start", "2": "r.stop", "5p": "CASE WHEN r.strand = '+' THEN r.start ELSE r.stop END", "3p": "CASE WHEN r.strand = '+' THEN r.stop ELSE r.start END"}[op]
    back = {"5p": f"{strand} = '-'", "3p": f"{strand} = '+'"}.get(op, "false")
    return f"CASE WHEN {back} THEN ({at}) - q.stop ELSE q.start - ({at}) END", f"CASE WHEN {back} THEN ({at}) - q.start ELSE q.stop - ({at}) END"


def _offset_pairs(test, ref, op: str, stranded: bool, size: str, how: dict) -> DataFrame:
    """region_id, ref_id, a and b (start and stop offset) and the reference region's size."""
    a, b = _offsets(op, "q.strand" if stranded else "r.strand")
    met = interval_join(test.where("size(iv) = 1"), ref, stranded=stranded, **how).withColumnRenamed("t", "q")
    return met.selectExpr("q.region_id", "r.region_id AS ref_id", f"{a} AS a", f"{b} AS b", f"{size} AS size")


def offset(test, ref, *, op="5p", fraction=False, centre=False, stranded=True, **how):
    """Offsets of single-interval test regions from the reference region's point ``op``.

    ``fraction``: over the reference region's size; ``centre``: the middle of both, truncated towards 0.
    """
    out = _offset_pairs(test, ref, op, stranded, "CASE WHEN r.one THEN r.stop - r.start + 1 ELSE aggregate(r.iv, 0L, (s, x) -> s + x.stop - x.start + 1) END", how)
    if centre:
        out = out.withColumn("a", F.expr("(a + b) div 2")).withColumn("b", F.col("a"))
    by = "/ size" if fraction else ""
    return out.selectExpr("region_id", "ref_id", f"a {by} AS start_offset", f"b {by} AS stop_offset")


def offset_without_gaps(test, ref, *, op="5p", stranded=True, **how):
    """Offsets along the spliced reference: of test intervals inside of one of its intervals; a row for each."""
    met = interval_join(test, ref, stranded=stranded, **how)
    met = met.select("t.region_id", "r", F.explode("t.iv").alias("q")).select("region_id", "r", "q", F.posexplode("r.iv").alias("k", "e")).where("q.start >= e.start AND q.stop <= e.stop")
    a, b = _offsets(op, "q.strand" if stranded else "r.strand")
    forward = {"1": "true", "2": "false", "5p": "r.strand = '+'", "3p": "r.strand = '-'"}[op]
    inner = "transform(slice(r.iv, 2, greatest(size(r.iv) - 1, 0)), (y, i) -> y.start - r.iv[i].stop - 1)"
    before, after = f"aggregate(slice({inner}, 1, k), 0L, (s, g) -> s + g)", f"aggregate(slice({inner}, k + 1, size(r.iv)), 0L, (s, g) -> s + g)"
    return met.selectExpr("region_id", "r.region_id AS ref_id", "k", "q.start", f"({a}) - CASE WHEN {forward} THEN {before} ELSE {after} END AS start_offset", f"({b}) - CASE WHEN {forward} THEN {before} ELSE {after} END AS stop_offset")


def annotate(test, ref, *, query_op="overlap", upstream_max=0, upstream_min=0, proximal=0, stranded=True, **how):
    """Reference regions that single test intervals meet, by 5' offset, and upstream flanks, by 3' offset, with a tag."""

    def by(refs: DataFrame, op: str) -> DataFrame:
        o = _offset_pairs(test, refs.where("size(iv) = 1"), op, stranded, "r.stop - r.start + 1", how)
        value = "a" if query_op == "overlap" else "(a + b) / 2"
        tag = f"CASE WHEN offset >= {proximal} THEN 'distal' ELSE 'proximal' END" if op == "3p" else f"CASE WHEN offset > {proximal} THEN 'distal:downstream' ELSE 'proximal:downstream' END"
        out = o.selectExpr("region_id", "ref_id", f"cast({value} AS double) AS offset", "size AS ref_size")
        out = out.selectExpr("region_id", "ref_id", f"'{'gene' if op == '5p' else 'upstream'}' AS kind", "offset", "offset / ref_size AS normalized", f"{tag} AS tag")
        return out if query_op == "overlap" else out.where("offset >= 0")

    out = by(ref, "5p")
    return out.unionByName(by(sets.annotator(ref, upstream_max, upstream_min, stranded=stranded), "3p")) if upstream_max > 0 else out


def bin_pairs(pairs, ref, *, stranded=True, **how):
    """For interval pairs: all reference regions that meet the first with all that meet the second.

    Both ends go through one join; a pair's references, a list for each end, are crossed where they are gathered.
    """
    ends = pairs.where("size(iv) = 2 AND region_id IS NOT NULL").selectExpr("region_id", "posexplode(iv) AS (k, x)").selectExpr("region_id", "cast(k as string) AS label", "array(x) AS iv")
    met = interval_join(ends, ref, stranded=stranded, **how).selectExpr("t.region_id", "t.label = '0' AS first", "struct(r.region_id AS id) AS r")
    sides = met.groupBy("region_id").agg(*[F.expr(f"collect_list(CASE WHEN {side} THEN r END) AS {name}") for side, name in (("first", "a"), ("NOT first", "b"))])
    return sides.select("region_id", F.explode("a").alias("a"), "b").select("region_id", "a", F.explode("b").alias("b")).selectExpr("region_id", "a.id AS ref_1", "b.id AS ref_2")


def pair_dist(pairs, ref, **how):
    """For interval pairs against breakpoints: offsets of their 3' and 5' ends, the least sum, and their span.

    An end that meets no breakpoint has a null offset; of several breakpoints the nearest counts.  It is found in one
    sweep for breakpoints of one interval with a strand, and among the pairs of the join for others.
    """
    two = pairs.where("size(iv) = 2").select("region_id", "label", "iv")
    ends = [(k, op, other, q) for k, (op, other, q) in enumerate((("3p", "5p", 0), ("3p", "5p", 1), ("5p", "3p", 0), ("5p", "3p", 1)))]
    plain = "size(iv) = 1 AND iv[0].strand IN ('+', '-')"
    at = two.selectExpr("region_id", f"inline(array({', '.join(f"struct({k} AS k, iv[{q}].chrom AS chrom, {point(op, f'iv[{q}]')} AS p)" for k, op, _, q in ends)}))")
    near = running.nearest(at.where("p IS NOT NULL"), flat(ref.where(plain)).where("start <= stop"))
    found = at.join(near, ["chrom", "p"]).selectExpr("region_id", "k", "CASE WHEN k < 2 THEN d5 ELSE d3 END AS o")
    if not (others := ref.where(f"NOT ({plain})")).isEmpty():
        for k, op, other, q in ends:
            p = point(op, f"iv[{q}]")
            one = two.selectExpr("region_id", "label", f"array(named_struct('chrom', iv[{q}].chrom, 'strand', iv[{q}].strand, 'start', {p}, 'stop', {p})) AS iv")
            found = found.union(offset(one, others, op=other, stranded=False, **how).selectExpr("region_id", f"{k}", "start_offset"))
    least = found.groupBy("region_id").agg(*[F.min(F.expr(f"CASE WHEN k = {k} AND o IS NOT NULL THEN struct(abs(o) AS a, o) END"))["o"].alias(f"offset_{k}") for k in range(4)])
    out = two.join(least, "region_id")
    sums = [f"offset_{a} + offset_{b}" for a, b in ((0, 1), (2, 3), (0, 3), (1, 2))]
    return out.where("coalesce(offset_0, offset_1, offset_2, offset_3) IS NOT NULL").selectExpr(
        "region_id", *[f"offset_{k}" for k in range(4)], f"least({', '.join(sums)}) AS least_sum",
        "CASE WHEN iv[0].chrom = iv[1].chrom THEN greatest(iv[0].stop, iv[1].stop) - least(iv[0].start, iv[1].start) END AS span",
    )


def per_test_count(test, ref, **how):
    """Reference regions that each test region meets (those that meet any)."""
    return interval_join(test, ref, **how).groupBy(F.col("t.region_id").alias("region_id")).agg(F.count("*").alias("hits"))


def per_test_coverage(test, ref, *, stranded=True, gaps=False, bits=None):
    """Bases that each test region shares with reference regions, summed over all that it meets.

    From running sums of reference bases at both ends of each test interval; with ``gaps`` (a region may meet others
    without a base in common) or ``bits`` from the pairs of the join.
    """
    if gaps or bits is not None:
        shared = "aggregate(t.iv, 0L, (s, x) -> s + aggregate(r.iv, 0L, (u, y) -> u + greatest(0L, least(x.stop, y.stop) - greatest(x.start, y.start) + 1)))"
        return interval_join(test, ref, stranded=stranded, gaps=gaps, bits=bits).selectExpr("t.region_id", f"{shared} AS shared").groupBy("region_id").agg(F.sum("shared").alias("coverage"))
    key = ["chrom", "strand"] if stranded else ["chrom"]
    ends = "inline(flatten(transform(filter(iv, x -> x.start <= x.stop), x -> array(named_struct('at', {0}, 'd', {2}), named_struct('at', {1}, 'd', -{2})))))".format
    events = flat(ref).where("start <= stop").selectExpr(*key, ends("x.start", "x.stop + 1", "1L"))
    asked = flat(test).where("start <= stop").selectExpr("region_id", *key, ends("x.stop", "x.start - 1", "1L"))
    # With n starts less stops up to p, and area the sum of their positions before, p * n - area bases lie up to p.
    out = asked.join(running.running(events, asked, key), [*key, "at"]).selectExpr("region_id", "d * (at * n - area) AS shared")
    return out.groupBy("region_id").agg(F.sum("shared").alias("coverage")).where("coverage > 0")
