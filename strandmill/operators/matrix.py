"""Matrix operations on rows (row_id, label, v array<double>); a column is its position in v, from 0."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import vectors as V
from strandmill.operators import vectors as rowwise

cutoff, test, pairs, shuffle, format_, sparse = rowwise.cutoff, rowwise.test, rowwise.pairs, rowwise.shuffle, rowwise.format_, rowwise.sparse


def long_form(df: DataFrame) -> DataFrame:
    return df.select("row_id", F.posexplode("v").alias("col_id", "x"))


def transpose(df):
    """Columns as rows, in the order of row_id."""
    cells = long_form(df).groupBy("col_id").agg(F.sort_array(F.collect_list(F.struct("row_id", "x"))).alias("c"))
    return cells.select(F.col("col_id").cast("long").alias("row_id"), F.transform("c", lambda c: c["x"]).alias("v"))


def norm(df, mean=0.0, sd=1.0):
    return df.withColumn("v", F.expr(f"transform(v, x -> (x - {mean}D) / {sd}D)"))


def rnorm(df, how="z"):
    return rowwise.norm(df, how)


def _columns(df: DataFrame) -> DataFrame:
    """Statistics of each column: sums that meet map-side, a row for each column."""
    x = F.when(~F.isnan("x"), F.col("x"))
    return long_form(df).groupBy("col_id").agg(F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))


def cnorm(df):
    """z-scores by column; the columns' statistics go to all rows as one map: as many entries as a row has values."""
    s = _columns(df).agg(F.map_from_entries(F.collect_list(F.struct("col_id", F.struct("mean", "sd")))).alias("s"))
    return df.join(F.broadcast(s)).withColumn("v", F.expr(f"transform(v, (x, j) -> {V.over('(x - s[j].mean)', 's[j].sd')})")).drop("s")


def cstat(df):
    return _columns(df)


def csum(df):
    return _columns(df).select("col_id", "sum")


def rstat(df):
    """Statistics of each row, with sd / mean and the count."""
    return rowwise.stat(df).selectExpr("row_id", "sum", "min", "max", "mean", "sd", "try_divide(sd, mean) AS cv", "n AS count")


def mult(df, c):
    return df.withColumn("v", F.expr(f"transform(v, x -> x * {c}D)"))


def encode(df, n_bins):
    """Column * n_bins + value."""
    return df.withColumn("v", F.expr(f"transform(v, (x, j) -> j * {n_bins}D + x)"))


def shrink(df):
    """Without the columns that are zero or NaN in every row; one list of columns goes to all rows."""
    keep = long_form(df).where("x <> 0 AND NOT isnan(x)").select("col_id").distinct().agg(F.sort_array(F.collect_list("col_id")).alias("keep"))
    return df.join(F.broadcast(keep)).withColumn("v", F.expr("transform(keep, j -> v[j])")).drop("keep")


def rel(df, how="previous"):
    """Ratios within the row: to the previous value, to the first, or of all pairs i < j (j over i)."""
    if how == "all":
        return df.withColumn("v", F.expr(f"flatten(transform(v, (x, i) -> transform(slice(v, i + 2, size(v)), y -> {V.over('y', 'x')})))"))
    base = "v[j]" if how == "previous" else "v[0]"
    return df.withColumn("v", F.expr(f"transform(slice(v, 2, greatest(size(v) - 1, 0)), (x, j) -> {V.over('x', base)})"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one is set where there is none and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_correlated(df, most=0.9):
    """Rows kept greedily by row_id: those whose correlation with every kept row is at most ``most``.

    Correlated pairs are found in blocks. Then, in rounds, every open row without a smaller open neighbour is
    kept and its neighbours go: what the greedy choice gives, in few rounds, with all decisions in DataFrames.
    """
    unit = df.withColumn("v", F.expr(V.once(V.mean("v"), "m", "transform(v, x -> x - m)")))
    unit = unit.withColumn("v", F.expr(V.once("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))", "n", "CASE WHEN n > 0 THEN transform(v, x -> x / n) END"))).where("v IS NOT NULL")
    dot = "aggregate(zip_with(i.v, j.v, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    near = _cut(pairs(unit).where(f"{dot} > {most}").selectExpr("i.row_id AS i", "j.row_id AS j"))
    kept, still = None, _cut(df.select("row_id"))
    while not still.isEmpty():
        live = near.join(still.withColumnRenamed("row_id", "i"), "i").join(still.withColumnRenamed("row_id", "j"), "j")
        first = _cut(still.join(live.select(F.col("j").alias("row_id")), "row_id", "left_anti"))
        gone = live.join(first.withColumnRenamed("row_id", "i"), "i", "left_semi").select(F.col("j").alias("row_id"))
        still = _cut(still.join(first.union(gone), "row_id", "left_anti"))
        kept = first if kept is None else kept.union(first)
    return df.join(kept, "row_id", "left_semi") if kept is not None else df
