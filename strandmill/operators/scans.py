"""Sliding-window counts over chromosomes, and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.regions import weight
from strandmill.functions.tails import binomial_q, normal_q, poisson_q, poisson_sample
from strandmill.operators.interval_join import flat, interval_join


def counts(reads: DataFrame, genome: DataFrame, *, size=500, step=25, least=1, op="1", stranded=True, ref=None, max_label_value=1.0) -> DataFrame:
    """chrom, strand, k (from 1), start, stop, n: windows [step (k - 1) + 1, step (k - 1) + size].

    ``op``: 1 (start), c (middle) or p (every position).  Each read adds to micro-bins of ``step`` positions,
    summed before they are dealt to the size / step windows that hold them.  The last length % step positions
    are in no window.  ``least`` of 0 gives empty windows too.  Without strands the strand is +.
    """
    if size % step:
        raise ValueError("the window size must be a multiple of the step")
    rows = flat(reads).select("chrom", F.col("strand") if stranded else F.lit("+").alias("strand"), "iv", weight(F.col("label"), max_label_value).alias("w"))
    one = rows.select("chrom", "strand", "w", F.explode("iv").alias("x"))
    if op == "p":
        one = one.select("*", F.explode(F.expr(f"sequence((x.start - 1) div {step}, (x.stop - 1) div {step})")).alias("bin"))
        one = one.withColumn("w", F.expr(f"w * (least(x.stop, (bin + 1) * {step}) - greatest(x.start, bin * {step} + 1) + 1)"))
    else:
        at = "x.start" if op == "1" else "x.start + (x.stop - x.start) div 2"
        one = one.withColumn("bin", F.expr(f"({at} - 1) div {step}"))
    lengths = F.broadcast(genome.select("chrom", "length"))  # a row for each chromosome
    micro = one.groupBy("chrom", "strand", "bin").agg(F.sum("w").alias("w")).join(lengths, "chrom").where(f"bin >= 0 AND bin < length div {step}")
    m = size // step
    last = f"length div {step} - {m}"
    holders = F.explode(F.expr(f"sequence(least(greatest(bin - {m - 1}, 0), {last}), least(bin, {last}))"))
    wins = micro.where(f"{last} >= 0").select("chrom", "strand", "w", "bin", holders.alias("k0")).where(f"k0 <= bin AND bin < k0 + {m}")
    n = wins.groupBy("chrom", "strand", "k0").agg(F.sum("w").alias("n"))
    if least <= 0:
        strands = F.explode(F.array(F.lit("+"), F.lit("-")) if stranded else F.array(F.lit("+")))
        dense = genome.where(f"length div {step} >= {m}").select("chrom", strands.alias("strand"), F.explode(F.expr(f"sequence(0L, length div {step} - {m})")).alias("k0"))
        n = dense.join(n, ["chrom", "strand", "k0"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    out = n.where(F.col("n") >= least).selectExpr("chrom", "strand", "k0 + 1 AS k", f"k0 * {step} + 1 AS start", f"k0 * {step} + {size} AS stop", "n")
    if ref is not None:
        as_regions = out.select(F.xxhash64("chrom", "strand", "k").alias("region_id"), F.lit("_").alias("label"), F.array(F.struct("chrom", "strand", "start", "stop")).alias("iv"))
        ids = interval_join(as_regions, ref, stranded=stranded, bits=max(8, (2 * size - 1).bit_length())).selectExpr("t.region_id AS id").distinct()
        out = out.join(ids, F.xxhash64("chrom", "strand", "k") == F.col("id"), "left_semi")
    return out


def background(reads: DataFrame, genome: DataFrame, unique: DataFrame | None = None) -> float:
    """Reads over positions: of the genome, or of the unique regions."""
    n = reads.count()
    size = (unique.select(F.explode("iv").alias("x")).agg(F.sum(F.expr("x.stop - x.start + 1"))) if unique is not None else genome.agg(F.sum("length"))).first()[0] or 0
    return n / size if size else 0.0


def q_cutoff(pairs: DataFrame, qval: float) -> float:
    """The p-value up to which q is at most ``qval``; p1 observed, p2 under the null.

    q of the k-th smallest p1 is the number of p2 up to it, over k, made monotone from the right; as in the
    definition followed here the smallest p1 alone never passes, and none passes of a single window.  Ranks run
    over distinct p-values with counts, in ranges; the driver sees one row.
    """
    both = pairs.selectExpr("p1 AS p", "1L AS a", "0L AS b").union(pairs.selectExpr("p2 AS p", "0L AS a", "1L AS b"))
    distinct = both.groupBy("p").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("tile", F.expr("cast(floor(ln(greatest(p, 1e-300)) * 4) as int)"))
    tiles = distinct.groupBy("tile").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))  # under 3,000 of them
    before = W.orderBy("tile").rowsBetween(W.unboundedPreceding, -1)
    tiles = tiles.select("tile", F.coalesce(F.sum("a").over(before), F.lit(0)).alias("a0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    inner = W.partitionBy("tile").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    q = distinct.join(F.broadcast(tiles), "tile").select("p", "a", (F.sum("a").over(inner) + F.col("a0")).alias("k"), (F.sum("b").over(inner) + F.col("b0")).alias("n_null"))
    n = pairs.count()
    best = q.where((F.col("a") > 0) & (F.col("n_null") / F.col("k") <= qval) & (F.col("k") > 1)).agg(F.max("p")).first()[0] if n > 1 else None
    return -1.0 if best is None else best


def peaks(signal: DataFrame, genome: DataFrame, control: DataFrame | None = None, *, size=500, step=25, least=1, pval=1e-5, qval=0.05, method="binomial", compare=False, norm=False, unique=None, stranded=False, seed=0, op="1") -> DataFrame:
    """Windows whose signal is unlikely by the background (or, with ``compare``, by the control), at a false-discovery cutoff.

    chrom, strand, start, stop, v1, v2, p1, p2.  Without a control its counts are drawn from a Poisson
    distribution with the signal's background rate, by a hash of window and seed.
    """
    how = {"size": size, "step": step, "op": op, "stranded": stranded}
    n1, n2 = signal.count(), (control if control is not None else signal).count()
    p_signal, key = background(signal, genome, unique), ["chrom", "strand", "k", "start", "stop"]
    p_control = background(control, genome, unique) if control is not None else p_signal
    v = counts(signal, genome, **how).withColumnRenamed("n", "v1")
    if control is not None:
        v = v.join(counts(control, genome, **how).withColumnRenamed("n", "v2"), key, "left")
    else:
        u = (F.pmod(F.xxhash64("chrom", "strand", "k", F.lit(seed)), F.lit(1000003)) + 0.5) / 1000003
        v = v.withColumn("v2", poisson_sample(F.lit(float(size * p_signal)), u))
    if unique is not None:
        v = v.join(counts(unique, genome, size=size, step=step, op="p", stranded=stranded).select("chrom", "strand", "k", F.col("n").alias("v0")), ["chrom", "strand", "k"], "left")
    else:
        v = v.withColumn("v0", F.lit(float(size)))
    v = v.select(*key, *[F.coalesce(c, F.lit(0.0)).cast("double").alias(c) for c in ("v0", "v1", "v2")])
    v = v.withColumns({"v1": F.least("v1", "v0"), "v2": F.least("v2", "v0")})
    ratio = p_signal / p_control if p_control else 1.0
    if norm:
        v = v.withColumn("v2", F.floor(F.col("v2") * ratio).cast("double")) if ratio < 1 else v.withColumn("v1", F.floor(F.col("v1") / ratio).cast("double"))
    v, lit = v.where(F.col("v1") >= least), lambda x: F.lit(float(x))

    def tail(a: str, b: str, pa: float, pb: float, na: int, nb: int):
        x, y, one = F.col(a), F.col(b), F.lit(1.0)
        if method == "binomial":
            return binomial_q(x, F.greatest((y + 1) / (F.col("v0") + 1), lit(pa)) if compare else lit(pa), F.col("v0") + one)
        if method == "poisson":
            return poisson_q(x + 5, y + 5)
        if not compare:
            raise ValueError(f"{method} needs compare=True")
        if method == "binomial2":
            return binomial_q(x + 1, (y + 1) / lit(nb), lit(na))
        if method == "cbinomial":
            return binomial_q(x + 1, lit(0.5), x + y + 2)
        if method == "normal":
            mean = (y + 1) / lit(nb) * lit(na)
            return normal_q((x + 1 - mean) / F.sqrt(mean))
        raise ValueError(f"no such method: {method}")

    found = v.withColumns({"p1": tail("v1", "v2", p_signal, p_control, n1, n2), "p2": tail("v2", "v1", p_control, p_signal, n2, n1)}).where(F.col("p1") <= pval)
    return found.where(F.col("p1") <= q_cutoff(found, qval)).drop("k", "v0")
