"""Per-row vector operations: rows (row_id, label, v array<double>); all but merge, pairs, hist and permute are projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions import vectors as V


def _v(df: DataFrame, expr: str) -> DataFrame:
    return df.withColumn("v", F.expr(expr))


def _value(df: DataFrame, expr: str, name: str = "value") -> DataFrame:
    return df.select("row_id", "label", F.expr(expr).alias(name))


def absmax(df):
    return _value(df, f"CASE WHEN abs(array_max({V.CLEAN})) >= abs(array_min({V.CLEAN})) THEN array_max({V.CLEAN}) ELSE array_min({V.CLEAN}) END")


def bins(df, n, low=None, high=None, merge=1):
    """A histogram for each row, bins [low, high) (its least and greatest value by default), ``merge`` bins summed."""
    lo, hi = (f"array_min({V.CLEAN})" if low is None else f"{low}D"), (f"array_max({V.CLEAN})" if high is None else f"{high}D")
    z = f"filter(transform({V.CLEAN}, x -> try_divide(x - r.lo, r.hi - r.lo)), z -> z >= 0 AND z < 1)"
    h = f"transform(sequence(0, {n - 1}), b -> cast(size(filter({z}, y -> cast(floor({n} * y) as int) = b)) as double))"
    h = V.once(f"named_struct('lo', {lo}, 'hi', {hi})", "r", h)
    return _v(df, h if merge == 1 else f"transform(sequence(0, {-(-n // merge) - 1}), b -> aggregate(slice({h}, b * {merge} + 1, {merge}), 0D, (s, x) -> s + x))")


def cutoff(df, c, replacement=0.0, upper=False):
    return _v(df, f"transform(v, x -> CASE WHEN x {'>' if upper else '<'} {c}D AND NOT isnan(x) THEN {replacement}D ELSE x END)")


def div(df):
    return _v(df, f"transform(slice(v, 2, greatest(size(v) - 1, 0)), x -> {V.over('x', 'v[0]')})")


def exp(df, base=2.718281828459045):
    return _v(df, f"transform(v, x -> pow({base}D, x))")


def log(df, base=2.718281828459045, pseudo=0.0):
    return _v(df, f"transform(v, x -> ({V.log_of(f'(x + {pseudo}D)')}) / ln({base}D))")


def pow_(df, p):
    return _v(df, f"transform(v, x -> pow(x, {p}D))")


def fold(df):
    """The values, then for j from 1 the change against the first and against the one before."""
    pair = f"array(({V.over('x', 'v[0]')}) - 1, ({V.over('x', 'v[j]')}) - 1)"
    return _v(df, f"concat(v, flatten(transform(slice(v, 2, greatest(size(v) - 1, 0)), (x, j) -> {pair})))")


def format_(df, pattern="%.6f", delimiter=" "):
    return _value(df, f"array_join(transform(v, x -> CASE WHEN isnan(x) THEN 'nan' ELSE format_string('{pattern}', x) END), '{delimiter}')", "text")


def hist(df, n, low, high):
    """start, fraction, count of each bin, over all rows."""
    x = df.select(F.explode("v").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    got = x.selectExpr(f"(x - {low}D) / {high - low}D AS z").selectExpr(f"CASE WHEN z >= 0 AND z < 1 THEN cast(floor({n} * z) as int) END AS bin").where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
    total = got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").join(F.broadcast(total))
    return every.selectExpr("bin", f"{low}D + bin * {(high - low) / n}D AS start", "try_divide(coalesce(n, 0), all) AS fraction", "coalesce(n, 0) AS count")


def imax(df):
    return _value(df, f"cast(array_position(v, array_max({V.CLEAN})) - 1 as bigint)")


def imin(df):
    return _value(df, f"cast(array_position(v, array_min({V.CLEAN})) - 1 as bigint)")


def items(df, n_bins):
    """n_bins * position + value of the non-zero values."""
    return _v(df, f"filter(transform(v, (x, j) -> CASE WHEN x <> 0 AND NOT isnan(x) THEN {n_bins}D * j + x END), y -> y IS NOT NULL)")


def m(df, trim=0.0):
    return _value(df, V.mean(V.trimmed(trim)))


def sd(df, trim=0.0):
    return _value(df, V.sd(V.trimmed(trim)))


def max_(df):
    return _value(df, f"array_max({V.CLEAN})")


def min_(df):
    return _value(df, f"array_min({V.CLEAN})")


def sum_(df):
    return _value(df, V.total())


def n(df):
    return _value(df, f"cast(size({V.CLEAN}) as bigint)")


def med(df):
    return _value(df, V.quantile(0.5))


def q(df):
    return _v(df, f"array({V.quantile(0)}, {V.quantile(0.25)}, {V.quantile(0.5)}, {V.quantile(0.75)}, {V.quantile(1)})")


def merge(df):
    """Consecutive rows (by row_id) of one label joined; a run's first row_id stays.

    Only label changes pass between tiles of rows, so one label with most rows is cut into parts that are then joined in order.
    """
    tiles = df.withColumn("tile", F.expr("row_id div 65536"))
    ends = tiles.groupBy("tile").agg(F.max_by("label", "row_id").alias("last"))
    before = ends.withColumn("before", F.lag("last").over(W.orderBy("tile"))).withColumn("head", F.lag("tile").over(W.orderBy("tile")).isNull())
    order = W.partitionBy("tile").orderBy("row_id")
    flagged = tiles.join(F.broadcast(before.drop("last")), "tile").withColumn("prev", F.coalesce(F.lag("label").over(order), "before"))
    first = F.when(F.col("label").eqNullSafe(F.col("prev")) & ~(F.col("head") & F.lag("row_id").over(order).isNull()), 0).otherwise(1)
    flagged = flagged.withColumn("new", first)
    starts = flagged.groupBy("tile").agg(F.sum("new").alias("s"))
    starts = starts.select("tile", (F.sum("s").over(W.orderBy("tile")) - F.col("s")).alias("base"))
    runs = flagged.join(F.broadcast(starts), "tile").withColumn("run", F.sum("new").over(order) + F.col("base"))
    out = runs.groupBy("run", "label").agg(F.min("row_id").alias("row_id"), F.sort_array(F.collect_list(F.struct("row_id", "v"))).alias("parts"))
    return out.select("row_id", "label", F.expr("flatten(transform(parts, p -> p.v))").alias("v"))


def norm(df, how="z", trim=0.0):
    """z-scores, the range to 0..1, or (trim > 0) z-scores by the trimmed mean and deviation; statistics once per row."""
    of = V.trimmed(trim) if trim else V.CLEAN
    a, b = (f"array_min({of})", f"array_max({of}) - array_min({of})") if how == "range" else (V.mean(of), V.sd(of))
    return _v(df, V.once(f"named_struct('a', {a}, 'b', {b})", "t", f"transform(v, x -> {V.over('(x - t.a)', 't.b')})"))


def pairs(df, block=512):
    """All row pairs i < j, in blocks of rows.

    A block is one row of arrays, a column that nobody asks for isn't in it, and two blocks meet once.  They are sorted
    and merged: the exploded side would look small enough for a broadcast, which the driver would have to hold.
    """
    n_blocks = -(-df.count() // block) or 1
    rows = df.where("row_id IS NOT NULL").withColumn("b", F.expr(f"pmod(xxhash64(row_id), {n_blocks})"))
    blocks = rows.groupBy("b").agg(F.collect_list("row_id").alias("ids"), *[F.collect_list(F.struct(c)).alias(f"{c}s") for c in ("label", "v")])
    left = blocks.select("b", F.explode(F.expr(f"sequence(b, {n_blocks - 1}L)")).alias("c"), "ids", "labels", "vs")
    right = blocks.select(F.explode(F.expr("sequence(0L, b)")).alias("b"), F.col("b").alias("c"), *[F.col(x).alias(f"{x}_2") for x in ("ids", "labels", "vs")])
    met = left.join(right.hint("merge"), ["b", "c"]).select("*", F.explode(F.expr("sequence(0, size(ids) - 1)")).alias("k"))
    # Both sides collect a block by themselves, each in an order of its own; so inside of one block ids are compared, not places.
    met = met.select("*", F.explode(F.expr("sequence(0, size(ids_2) - 1)")).alias("l")).where("CASE WHEN b < c THEN ids[k] <> ids_2[l] ELSE ids[k] < ids_2[l] END")
    one, two, first = ("ids[k]", "labels[k].label", "vs[k].v"), ("ids_2[l]", "labels_2[l].label", "vs_2[l].v"), "ids[k] < ids_2[l]"
    row = "struct({} AS row_id, {} AS label, {} AS v) AS {}".format
    return met.selectExpr(row(*[f"CASE WHEN {first} THEN {x} ELSE {y} END" for x, y in zip(one, two)], "i"), row(*[f"CASE WHEN {first} THEN {y} ELSE {x} END" for x, y in zip(one, two)], "j"))


def permute(df, seed=0):
    """The rows in random order: by a hash of row and seed."""
    return df.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id")


def shuffle(df, seed=0):
    """The elements of each row in random order."""
    return _v(df, f"transform(array_sort(transform(v, (x, j) -> struct(xxhash64(row_id, j, {seed}) AS h, j, x))), y -> y.x)")


def rank(df, normalised=False):
    """Ordinal ranks from 1, ties by position."""
    places = "transform(array_sort(transform(v, (x, j) -> struct(x, j))), y -> y.j)"
    by = " / size(v)" if normalised else ""
    return _v(df, V.once(places, "p", f"transform(v, (x, j) -> cast(array_position(p, j) as double){by})"))


def rev(df):
    return _v(df, "reverse(v)")


def sort(df):
    return _v(df, "array_sort(v)")


def slide(df, radius, step=1):
    """Sub-vectors of 2 * radius + 1 values, every ``step``; ``part`` counts from 0."""
    w = 2 * radius + 1
    starts = F.expr(f"CASE WHEN size(v) >= {w} THEN sequence(1, size(v) - {w - 1}, {step}) ELSE array() END")
    return df.select("row_id", "label", "v", F.posexplode(starts).alias("part", "s")).withColumn("v", F.expr(f"slice(v, s, {w})")).drop("s")


def sparse(df, start=0):
    """k:v of the values that are neither zero nor NaN; k from ``start``.  v is rounded from its exact value, ties to even."""
    return df.select("row_id", "label", V.sparse_text(F.col("v"), F.lit(start)).alias("text"))


def stat(df):
    return df.select("row_id", "label", *[F.expr(e).alias(k) for k, e in (("n", f"cast(size({V.CLEAN}) as bigint)"), ("sum", V.total()), ("min", f"array_min({V.CLEAN})"), ("max", f"array_max({V.CLEAN})"), ("mean", V.mean()), ("sd", V.sd()), ("median", V.quantile(0.5)))])


def test(df, c, op=">="):
    """0 or 1: does each value compare so?  op: >=, > or =."""
    return _v(df, f"transform(v, x -> CASE WHEN x {op} {c}D AND NOT isnan(x) THEN 1D ELSE 0D END)")
