"""Region sets, vectors and categories as projections of the driver's tables, in Spark and (CTES) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHROMS, LENGTH = 10, 110_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; where it has fewer files than there are cores, its rows are spread over all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _iv(chrom: str, strand: str, start: str, stop: str) -> str:
    return f"named_struct('chrom', {chrom}, 'strand', {strand}, 'start', cast({start} as bigint), 'stop', cast({stop} as bigint))"


def reads(spark, d):
    """Rows of lineitem; region_id isn't unique, as the table's key isn't."""
    start = "l_partkey * 50 + datediff(l_shipdate, date'1992-01-01')"
    iv = _iv("concat('chr', l_suppkey % 10)", "CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END", start, f"{start} + cast(l_quantity as bigint) - 1")
    return table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS region_id", "cast(cast(l_quantity as bigint) as string) AS label", f"array({iv}) AS iv", "l_returnflag")


def refs(spark, d):
    start = "1 + (o_orderkey * 7919) % 100000"
    iv = _iv("concat('chr', o_custkey % 10)", "CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END", start, f"{start} + 499")
    return table(spark, d, "orders").selectExpr("o_orderkey AS region_id", "concat('r', o_orderkey) AS label", f"array({iv}) AS iv")


def tests(spark, d):
    """A unique key on the test side, and mixed lengths."""
    start = "1 + (o_orderkey * 104729) % 100000"
    iv = _iv("concat('chr', (o_custkey * 3) % 10)", "CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END", start, f"{start} + 9 + o_custkey % 290")
    return table(spark, d, "orders").selectExpr("o_orderkey AS region_id", "cast(o_orderkey % 7 as string) AS label", f"array({iv}) AS iv")


def spliced(spark, d, *, apart=False):
    """One to three intervals; they overlap, touch or leave gaps, or with ``apart`` always leave gaps."""
    step = "((o_orderkey % 7) * 60 + 300)" if apart else "((o_orderkey % 7) * 60)"
    start = f"1 + (o_orderkey * 7919) % 100000 + k * {step}"
    iv = _iv("concat('chr', o_custkey % 10)", "CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END", start, f"{start} + 99 + (o_custkey % 5) * 40")
    return table(spark, d, "orders").selectExpr("o_orderkey AS region_id", "concat('r', o_orderkey) AS label", f"transform(sequence(0, cast(o_orderkey % 3 as int)), k -> {iv}) AS iv")


def genome(spark, regions=None):
    """Chromosomes of LENGTH, which holds refs, tests, spliced and pairs at every scale; longer, by whole thousands, where ``regions`` reach further."""
    reach = regions.select(F.explode("iv.stop").alias("stop")).agg(F.max("stop")).first()[0] if regions is not None else None
    length = max(LENGTH, -(-(reach or 0) // 1000) * 1000)
    return spark.range(CHROMS).selectExpr("concat('chr', id) AS chrom", f"cast({length} as bigint) AS length")


def pairs(spark, d):
    """Pairs of points of orders and their supplier-like mate; chromosomes mix."""
    a = _iv("concat('chr', o_custkey % 10)", "CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END", "1 + (o_orderkey * 7919) % 100000", "1 + (o_orderkey * 7919) % 100000 + 49")
    b = _iv("concat('chr', (o_custkey * 7) % 10)", "CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END", "1 + (o_custkey * 613) % 100000", "1 + (o_custkey * 613) % 100000 + 49")
    return table(spark, d, "orders").selectExpr("o_orderkey AS region_id", "concat('p', o_orderkey) AS label", f"array({a}, {b}) AS iv")


def hic_reads(spark, d):
    chrom = "CASE WHEN {0} % 13 = 0 THEN '*' ELSE concat('chr', {1} % 10) END"
    one = ["o_orderkey AS read_id", "0 AS mate", f"{chrom.format('o_orderkey', 'o_custkey')} AS chrom", "CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand", "1 + (o_orderkey * 7919) % 100000 AS start", "1 + (o_orderkey * 7919) % 100000 + 49 AS stop", "o_orderkey % 11 = 0 AS multi"]
    two = ["o_orderkey AS read_id", "1 AS mate", f"{chrom.format('o_custkey', 'o_custkey')} AS chrom", "CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand", "1 + (o_orderkey * 7919) % 100000 + o_custkey * 3 AS start", "1 + (o_orderkey * 7919) % 100000 + o_custkey * 3 + 49 AS stop", "o_custkey % 7 = 0 AS multi"]
    o = table(spark, d, "orders")
    return o.selectExpr(*one).union(o.where("o_orderkey % 17 <> 0").selectExpr(*two))


def fragments(spark, d):
    """Restriction fragments of 4,000 positions with small gaps, 27 for each chromosome or as far as hic_reads reach."""
    n = max(27, -(-(hic_reads(spark, d).agg(F.max("stop")).first()[0] or 0) // 4000))
    iv = _iv("concat('chr', c)", "'+'", "k * 4000 + 1", "k * 4000 + 3990")
    return spark.range(CHROMS * n).selectExpr("id", "id % 10 AS c", "id div 10 AS k").selectExpr("id AS region_id", "concat('f', id) AS label", f"array({iv}) AS iv")


def vec(spark, d):
    return table(spark, d, "embeddings").selectExpr("vec_id AS row_id", "concat('L', vec_id div 3 % 2) AS label", "transform(embedding, x -> cast(x as double)) AS v")


def cats(spark, d):
    return table(spark, d, "part").selectExpr("cast(p_partkey as string) AS label", "p_retailprice - 950 AS value", "cast(p_size + 1 as double) AS total", "array(p_brand, p_type) AS categories")


CTES = f"""WITH reads AS (SELECT l_orderkey * 10 + l_linenumber AS region_id, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS label, 'chr' || (l_suppkey % 10) AS chrom,
    CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand, l_partkey * 50 + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS start,
    l_partkey * 50 + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) - 1 AS stop, l_returnflag FROM lineitem),
refs AS (SELECT o_orderkey AS region_id, 'r' || o_orderkey AS label, 'chr' || (o_custkey % 10) AS chrom, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    1 + (o_orderkey * 7919) % 100000 AS start, 1 + (o_orderkey * 7919) % 100000 + 499 AS stop FROM orders),
tests AS (SELECT o_orderkey AS region_id, CAST(o_orderkey % 7 AS VARCHAR) AS label, 'chr' || ((o_custkey * 3) % 10) AS chrom, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    1 + (o_orderkey * 104729) % 100000 AS start, 1 + (o_orderkey * 104729) % 100000 + 9 + o_custkey % 290 AS stop FROM orders),
spl AS (SELECT o_orderkey AS region_id, k, 'chr' || (o_custkey % 10) AS chrom, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    1 + (o_orderkey * 7919) % 100000 + k * ((o_orderkey % 7) * 60) AS start, 1 + (o_orderkey * 7919) % 100000 + k * ((o_orderkey % 7) * 60) + 99 + (o_custkey % 5) * 40 AS stop
    FROM orders, range(3) t(k) WHERE k <= o_orderkey % 3),
apart AS (SELECT o_orderkey AS region_id, k, 'chr' || (o_custkey % 10) AS chrom, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    1 + (o_orderkey * 7919) % 100000 + k * ((o_orderkey % 7) * 60 + 300) AS start, 1 + (o_orderkey * 7919) % 100000 + k * ((o_orderkey % 7) * 60 + 300) + 99 + (o_custkey % 5) * 40 AS stop
    FROM orders, range(3) t(k) WHERE k <= o_orderkey % 3),
genome AS (SELECT 'chr' || k AS chrom, {LENGTH}::BIGINT AS length FROM range({CHROMS}) t(k)),
prs AS (SELECT o_orderkey AS region_id, 'chr' || (o_custkey % 10) AS chrom_a, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand_a, 1 + (o_orderkey * 7919) % 100000 AS start_a,
    'chr' || ((o_custkey * 7) % 10) AS chrom_b, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand_b, 1 + (o_custkey * 613) % 100000 AS start_b FROM orders),
vec AS (SELECT vec_id AS row_id, 'L' || (vec_id // 3 % 2) AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
cell AS (SELECT row_id, label, unnest(generate_series(0, len(v) - 1)) AS j, unnest(v) AS x FROM vec),
mem AS (SELECT p_partkey, p_retailprice - 950 AS value, (p_size + 1)::DOUBLE AS total, unnest([p_brand, p_type]) AS category FROM part),
allp AS (SELECT count(*) AS n_all, sum(p_retailprice - 950) AS v_all, sum(p_size + 1)::DOUBLE AS d_all, sum((p_retailprice - 950) / (p_size + 1)) AS z_all,
    sum(pow((p_retailprice - 950) / (p_size + 1), 2)) AS zz_all, count(*) FILTER (p_retailprice - 950 > 0) AS k_all FROM part),
cat AS (SELECT category, count(*) AS n, sum(value) AS v, sum(total) AS d, sum(value / total) AS z, sum(pow(value / total, 2)) AS zz, count(*) FILTER (value > 0) AS k, abs(corr(value, total)) AS r
    FROM mem GROUP BY category HAVING count(*) >= 10),
"""
