"""Category enrichment: rows (label, value, total, categories array<string>)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.tails import hypergeometric_p, t_q


def _members(rows: DataFrame) -> DataFrame:
    return rows.select("label", "value", "total", F.explode(F.array_distinct("categories")).alias("category"))


#: The sums that all statistics are made of; ``r`` is of a category alone, and null where either side is constant.
_SUMS = ("n", "v", "d", "z", "zz", "k", "r")


def _sums(under: bool, totals: bool) -> list:
    z, d = ("value / total", "total") if totals else ("value", "1D")
    hit = "value < 0" if under else "value > 0"
    return [F.count("*"), F.sum("value"), F.sum(F.expr(d)), F.sum(F.expr(z)), F.sum(F.expr(f"({z}) * ({z})")), F.sum(F.expr(f"CASE WHEN {hit} THEN 1L ELSE 0L END")), F.abs(F.try_divide(F.covar_pop("value", "total"), F.stddev_pop("value") * F.stddev_pop("total")))]


def _every(rows: DataFrame, under: bool, totals: bool) -> DataFrame:
    """One row: the sums over all rows."""
    return rows.agg(*[s.alias(f"{c}_all") for s, c in zip(_sums(under, totals)[:6], _SUMS[:6], strict=True)])


def _score(x: DataFrame, how: str, under: bool, approx: bool, totals: bool) -> DataFrame:
    """With y, from the sums of a category and of all rows."""
    m1, m0 = "v / d", "(v_all - v) / (d_all - d)"
    s1, s0 = "(zz / n - pow(z / n, 2)) / n", "((zz_all - zz) / (n_all - n) - pow((z_all - z) / (n_all - n), 2)) / (n_all - n)"
    sign = "-" if under else ""
    formula = {
        "sum": f"try_divide({sign}v, {'d' if totals else 'n'})", "n": "cast(k as double)", "sens": "try_divide(k, n)", "spec": "try_divide(k, k_all)",
        "ratio": f"CASE WHEN n < n_all THEN try_divide({m0}, {m1}) END" if under else f"CASE WHEN n < n_all THEN try_divide({m1}, {m0}) END",
        "t": f"CASE WHEN n < n_all THEN {sign}try_divide({m1} - {m0}, sqrt({s1} + {s0})) END", "corr": "r",
    }[how]
    out = x.withColumn("y", F.expr(formula))
    if approx and how == "n":
        out = out.withColumn("y", hypergeometric_p("k", "k_all", F.expr("n_all - k_all"), "n"))
    elif approx and how == "t":
        df = F.floor(F.expr(f"pow({s1} + {s0}, 2) / (pow({s1}, 2) / (n - 1) + pow({s0}, 2) / (n_all - n - 1))"))
        out = out.withColumn("y", t_q("y", df.cast("double")))
    elif approx and how == "corr":
        out = out.withColumn("y", 2 * t_q(F.expr("r * sqrt(try_divide(n - 2, 1 - r * r))"), F.expr("cast(n - 2 as double)")))
    return out


def statistic(rows: DataFrame, how: str, *, least=10, most=None, under=False, approx=False, totals=True) -> DataFrame:
    """category, size, y for categories with ``least`` to ``most`` members.

    how: sum, n, sens, spec, ratio, t or corr.  ``under`` asks for depletion; ``approx`` gives tail
    probabilities where they are defined; ``totals`` weighs values by their totals.
    """
    inside = _members(rows).groupBy("category").agg(*[s.alias(c) for s, c in zip(_sums(under, totals), _SUMS, strict=True)])
    inside = inside.where(f"n >= {least}" + (f" AND n <= {most}" if most else ""))
    out = _score(inside.join(F.broadcast(_every(rows, under, totals))), how, under, approx, totals)
    return out.select("category", F.col("n").alias("size"), "y")


def _dealt(rows: DataFrame, how: str, permutations: int, seed: int, under: bool, approx: bool, totals: bool) -> DataFrame:
    """perm, category, y0: the statistic where values are dealt to labels by the order of a hash.

    Ranks are counted in tiles of the hash, so no task orders all labels of a permutation.
    """
    spark = rows.sparkSession
    every = rows.select("label", "value", "total", "categories").crossJoin(F.broadcast(spark.range(permutations).withColumnRenamed("id", "perm")))

    def ranked(df: DataFrame, h, keep: list[str]) -> DataFrame:
        d = df.withColumn("h", h).withColumn("tile", F.pmod(F.shiftright("h", 48), F.lit(64)))
        before = F.sum("count").over(W.partitionBy("perm").orderBy("tile")) - F.col("count")
        base = d.groupBy("perm", "tile").count().select("perm", "tile", before.alias("before"))
        nr = F.row_number().over(W.partitionBy("perm", "tile").orderBy("h", "label"))
        return d.join(base, ["perm", "tile"]).select("perm", (nr + F.col("before")).alias("nr"), *keep)

    to = ranked(every, F.xxhash64("label", F.lit(seed)), ["label", "categories"])
    by = ranked(every, F.xxhash64("label", "perm", F.lit(seed + 1)), ["value", "total"])
    inside = to.join(by, ["perm", "nr"]).select("perm", "value", "total", F.explode(F.array_distinct("categories")).alias("category"))
    runs = inside.groupBy("perm", "category").agg(*[s.alias(c) for s, c in zip(_sums(under, totals), _SUMS, strict=True)])
    out = _score(runs.join(F.broadcast(_every(rows, under, totals))), how, under, approx, totals)
    return out.select("perm", "category", F.col("y").alias("y0"))


def empirical(rows: DataFrame, how: str, *, permutations=100, seed=0, least=10, most=None, under=False, totals=True) -> DataFrame:
    """category, size, y, p: the share of permutations whose statistic is at least as large; of every ``how``."""
    observed = statistic(rows, how, least=least, most=most, under=under, totals=totals)
    y = _dealt(rows, how, permutations, seed, under, False, totals)
    share = y.join(observed, "category").groupBy("category").agg((F.sum(F.when(F.col("y0") >= F.col("y"), 1).otherwise(0)) / permutations).alias("p"))
    return observed.join(share, "category")


def permuted_fdr(rows: DataFrame, how: str, *, permutations=100, seed=0, least=10, most=None, under=False, totals=True) -> DataFrame:
    """category, size, p, fdr: tail probabilities (n, t or corr) against those of permuted values.

    ``fdr``: how many categories of a permutation have such a p or less, on average, over the rank of p; from the largest
    p down it doesn't rise.  Permuted values are counted first, then in tiles of p; categories are ranked in one window.
    """
    observed = statistic(rows, how, least=least, most=most, under=under, approx=True, totals=totals).withColumnRenamed("y", "p").where("p IS NOT NULL")
    chance = _dealt(rows, how, permutations, seed, under, True, totals).join(observed.select("category"), "category", "left_semi")
    chance = chance.where("y0 IS NOT NULL").groupBy(F.col("y0").alias("p")).agg(F.count("*").alias("c"))
    both = observed.select("category", "p", F.lit(0).cast("long").alias("c")).union(chance.select(F.lit(None).cast("string"), "p", "c"))
    both = both.withColumn("tile", F.floor(F.least(F.col("p"), F.lit(1.0)) * 1024).cast("int"))
    before = both.groupBy("tile").agg(F.sum("c").alias("t")).select("tile", (F.sum("t").over(W.orderBy("tile")) - F.col("t")).alias("before"))
    inside = F.sum("c").over(W.partitionBy("tile").orderBy("p").rangeBetween(W.unboundedPreceding, 0))
    counted = both.withColumn("inside", inside).join(before, "tile").where("category IS NOT NULL").select("category", (F.col("before") + F.col("inside")).alias("c"))
    ranked = observed.join(counted, "category").withColumn("nr", F.row_number().over(W.orderBy("p", "category")))
    raw = F.col("c") / permutations / F.col("nr")
    down = W.orderBy(F.desc("nr")).rowsBetween(W.unboundedPreceding, 0)
    return ranked.select("category", "size", "p", F.min(raw).over(down).alias("fdr"))


def adjusted(tested: DataFrame, p: str = "p") -> DataFrame:
    """With ``fdr`` (Benjamini and Hochberg) and ``q``: q of the least p is 0, then (c + 1) F[c] - c F[c - 1], monotone, at most 1.

    There is a row for each category, few against the rows tested; they are ranked in one window.
    """
    order = W.orderBy(p, "category")
    nr, n = F.row_number().over(order), F.count("*").over(W.partitionBy())
    raw = tested.withColumn("nr", nr).withColumn("raw", F.least(F.col(p) * n / F.col("nr"), F.lit(1.0)))
    down = W.orderBy(F.desc("nr")).rowsBetween(W.unboundedPreceding, 0)
    fdr = raw.withColumn("fdr", F.min("raw").over(down))
    back = F.lag("fdr").over(W.orderBy("nr"))
    step = F.when(F.col("nr") == 1, F.lit(0.0)).otherwise(F.col("nr") * F.col("fdr") - (F.col("nr") - 1) * back)
    q = F.least(F.max("step").over(W.orderBy("nr").rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0))
    return fdr.withColumn("step", step).withColumn("q", q).drop("nr", "raw", "step")
