"""Region operators on hand-made intervals."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandmill.functions import vectors as vec_sql
from strandmill.functions.regions import INTERVAL
from strandmill.functions.tails import binomial_tail, poisson_draw, poisson_tail, t_tail
from strandmill.operators import enrichment, hic, interval_join as joins, matrix, overlaps, profiles, regions, scans, sets, vectors
from strandmill.operators.interval_join import interval_join


@pytest.fixture(scope="module")
def make(spark):
    def build(*rows):
        data = [(i, label, [("chr1", strand, a, b) for a, b in ivs]) for i, (label, strand, ivs) in enumerate(rows)]
        return spark.createDataFrame(data, f"region_id long, label string, iv array<{INTERVAL}>")

    return build


@pytest.fixture(scope="module")
def genome(spark):
    return spark.createDataFrame([("chr1", 100)], "chrom string, length long")


def ivs(df):
    return [[(x.start, x.stop) for x in r.iv] for r in df.orderBy("region_id").collect()]


def test_row_transforms(make):
    one = make(("a", "+", [(1, 4)]), ("b", "+", [(1, 5)]))
    assert ivs(regions.center(one)) == [[(2, 3)], [(3, 3)]]
    assert ivs(regions.divide(one)) == [[(1, 2), (3, 4)], [(1, 2), (3, 5)]]
    assert ivs(regions.pos(make(("a", "+", [(100, 199)])), "c", 10)) == [[(140, 160)]]
    assert ivs(regions.shiftp(make(("a", "-", [(100, 200)])), -10, 20)) == [[(80, 210)]]
    assert ivs(regions.union(make(("a", "+", [(1, 10), (11, 20)]), ("b", "+", [(1, 10), (10, 20)])))) == [[(1, 10), (11, 20)], [(1, 20)]]
    assert ivs(regions.diff(make(("a", "+", [(1, 10), (21, 30)]), ("b", "+", [(1, 2)])))) == [[(11, 20)]]
    assert ivs(regions.win(make(("a", "+", [(1, 6)])), 3, 2).withColumn("region_id", F.col("part"))) == [[(1, 3)], [(3, 5)]]
    assert ivs(regions.win(make(("a", "+", [(1, 6)])), 3, 2, True).withColumn("region_id", F.col("part"))) == [[(1, 3)], [(3, 5)], [(5, 6)]]
    assert regions.select(make(("a", "+", [(1, 2), (5, 6)]))).count() == 0
    assert ivs(regions.fix(make(("a", "+", [(0, 2), (5, 4), (3, 3)])))) == [[(3, 3)]]


def test_sets(make, genome):
    near = make(("a", "+", [(1, 10)]), ("b", "+", [(11, 20)]))
    assert sets.link(near).count() == 2 and ivs(sets.link(near, distance=1)) == [[(1, 20)]]
    gap = make(("a", "+", [(11, 20)]))
    assert sorted(ivs(sets.inv(gap, genome))) == [[(1, 10)], [(21, 100)]]
    short = genome.withColumn("length", F.lit(21))
    assert sorted(ivs(sets.inv(gap, short))) == [[(1, 10)], [(21, 21)]] and ivs(sets.inv(gap, short, compat=True)) == [[(1, 10)]]
    nested = make(("a", "+", [(1, 50)]), ("b", "+", [(10, 20)]), ("c", "+", [(60, 70)]))
    assert sorted(ivs(sets.inv(nested, genome))) == [[(51, 59)], [(71, 100)]]
    assert sorted(ivs(sets.cluster(nested))) == [[(1, 50)], [(60, 70)]]
    assert sets.test(nested).first().inclusions == 1


def test_overlaps(make):
    tests, ref = make(("1", "+", [(1, 5)]), ("1", "+", [(4, 8)])), make(("r", "+", [(1, 10)]))
    assert overlaps.density(tests, ref).first().density == 1.0
    o = overlaps.offset(make(("t", "-", [(190, 195)])), make(("r", "-", [(100, 200)])), op="5p").first()
    assert (o.start_offset, o.stop_offset) == (5, 10)
    hits = make(*[("t", "+", [(i + 1, i + 2)]) for i in range(3)], ("t", "+", [(5000, 5001)]))
    two = make(("a", "+", [(1, 1000)]), ("b", "+", [(5000, 5499)]))
    assert [r.rpkm for r in overlaps.rpkm(hits, two).orderBy("region_id").collect()] == [750000.0, 500000.0]
    assert overlaps.count(hits, make(("z", "+", [(9000, 9001)]))).first().hits == 0


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_join_is_free_of_bin_width(make, bits):
    a = [("a", "+-"[i % 2], [(1 + i * 7 % 90, 1 + i * 7 % 90 + i % 13)]) for i in range(60)]
    b = [("b", "+-"[i % 3 % 2], [(1 + i * 11 % 90, 1 + i * 11 % 90 + i % 29)]) for i in range(50)]
    got = sorted((r[0], r[1]) for r in interval_join(make(*a), make(*b), bits=bits).selectExpr("t.region_id", "r.region_id").collect())
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] == y[1] and x[2][0][0] <= y[2][0][1] and x[2][0][1] >= y[2][0][0])
    assert got == want


def test_subset_parts_the_tests(make):
    t = make(*[("t", "+", [(i * 10, i * 10 + 5)]) for i in range(1, 9)])
    r = make(("r", "+", [(12, 33)]))
    assert sorted(ivs(overlaps.subset(t, r)) + ivs(overlaps.subset(t, r, inverse=True))) == ivs(t)


def test_windows(make, genome):
    reads = make(*[("x", "+", [(p, p)]) for p in (1, 2, 3, 9)])
    got = [(r.start, r.stop, r.n) for r in scans.counts(reads, genome.withColumn("length", F.lit(9)), size=4, step=2, least=0, stranded=False).orderBy("k").collect()]
    assert got == [(1, 4, 3.0), (3, 6, 1.0), (5, 8, 0.0)]
    assert scans.peaks(reads, genome, size=4, step=2, pval=1.0, qval=1.0, seed=1).columns == ["chrom", "strand", "start", "stop", "v1", "v2", "p1", "p2"]


def test_q_cutoff(spark):
    cases = [[(i / 1000, (i * 37 % 101 + 20) / 150) for i in range(1, 101)], [(0.0, 0.5), (0.0, 0.6), (0.01, 0.001), (0.2, 0.1)], [(0.1, 0.9)], [(0.3, 0.0), (0.4, 0.0)]]
    for rows in cases:
        for qval in (0.0, 0.05, 0.3, 1.0):
            good = [p for p, _ in rows if (k := sum(x <= p for x, _ in rows)) > 1 and sum(y <= p for _, y in rows) / k <= qval]
            assert scans.q_cutoff(spark.createDataFrame(rows, "p1 double, p2 double"), qval) == max(good, default=-1.0)
    assert scans.q_cutoff(spark.createDataFrame(cases[0], "p1 double, p2 double"), 0.05) > 0


@pytest.mark.parametrize("method", ["binomial", "poisson", "binomial2", "cbinomial", "normal"])
def test_peaks_are_found(make, genome, method):
    """40 reads more in two windows of the signal, spread evenly in the control."""
    signal = make(*[("x", "+", [(p, p)]) for p in [201 + i % 40 for i in range(40)] + [601 + i % 40 for i in range(40)] + list(range(1, 1000, 20))])
    control = make(*[("x", "+", [(p, p)]) for p in range(1, 1000, 8)])
    got = scans.peaks(signal, genome.withColumn("length", F.lit(1000)), control, size=50, step=50, pval=0.05, qval=0.05, method=method, compare=True).collect()
    assert sorted((r.start, r.stop, r.v1) for r in got) == [(201, 250, 43.0), (601, 650, 43.0)]


def test_peaks_against_drawn_counts(make, genome):
    """Without a control: the same windows for the same seed, counts of the background's mean and variance for it."""
    signal = make(*[("x", "+", [(p, p)]) for p in [*range(201, 241), *range(6001, 6041), *range(1, 10_000, 10)]])
    how = {"size": 50, "step": 50, "pval": 0.05, "qval": 0.05}
    one, two = (scans.peaks(signal, genome.withColumn("length", F.lit(10_000)), **how, seed=7).collect() for _ in range(2))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and sorted((r.start, r.stop, r.v1) for r in one) == [(201, 250, 45.0), (6001, 6050, 45.0)]
    drawn = scans.peaks(signal, genome.withColumn("length", F.lit(10_000)), size=50, step=50, pval=1.0, qval=9.0, seed=7).select("v2").toPandas()["v2"]
    assert len(drawn) == 200 and abs(drawn.mean() - 5.4) < 0.6 and 3.5 < drawn.var() < 7.5


def test_tails():
    assert abs(binomial_tail([25], 0.018, 501)[0] - 2.286733848e-06) < 1e-12
    assert abs(poisson_tail([10], [5.0])[0] - 0.013695269) < 1e-8 and abs(t_tail([2.0], [10])[0] - 0.036694017) < 1e-8


def test_poisson_draws():
    u = [(i + 0.5) / 20_000 for i in range(20_000)]
    for mu in (0.0, 0.3, 7.0, 480.0, 3000.0):
        x = poisson_draw([mu] * len(u), u)
        assert abs(x.mean() - mu) < 0.01 * mu + 1e-9 and abs(x.var() - mu) < 0.02 * mu + 1e-9
    assert poisson_draw([2.0] * 3, [0.1353, 0.1354, 0.999999]).tolist() == [0.0, 1.0, 12.0]


def test_single_replicates_can_be_refused(spark):
    """Counts as small as 2 against 7 are noise."""
    ids = "chrom string, strand string, k long, a_1 double, b_1 double"
    noise = [("chr1", "+", i, float(2 + i * 7 % 9), float(2 + i * 7 % 9 + (5 if i % 50 == 0 else 0))) for i in range(400)]
    got = profiles.peakdiff(spark.createDataFrame(noise, ids), "a", "b").collect()
    assert len(got) == 400 and not any(r.gain or r.loss for r in got)


def test_vectors_and_matrices(spark):
    v = spark.createDataFrame([(0, "a", [3.0, 1.0, float("nan")]), (1, "a", [2.0, 2.0, 4.0]), (2, "b", [0.0, 5.0, 1.0])], "row_id long, label string, v array<double>")
    assert [r.value for r in vectors.m(v).orderBy("row_id").collect()] == [2.0, 8 / 3, 2.0]
    assert [r.value for r in vectors.sd(v).orderBy("row_id").collect()][0] == 1.0
    assert vectors.merge(v).count() == 2 and len(vectors.merge(v).orderBy("row_id").first().v) == 6
    assert vectors.rank(v).orderBy("row_id").collect()[1].v == [1.0, 2.0, 3.0]
    assert vectors.sparse(v).orderBy("row_id").first().text == "0:3.000000 1:1.000000"
    assert matrix.transpose(v).orderBy("row_id").collect()[1].v == [1.0, 2.0, 5.0]
    same = spark.createDataFrame([(0, "a", [1.0, 2.0, 3.0]), (1, "b", [2.0, 4.0, 6.0]), (2, "c", [3.0, 1.0, 2.0])], "row_id long, label string, v array<double>")
    assert [r.row_id for r in matrix.drop_correlated(same, 0.9).orderBy("row_id").collect()] == [0, 2]


def test_contacts(spark):
    pairs = spark.createDataFrame([(0, "p", [("chr1", "+", 10, 10), ("chr1", "-", 95, 95)])], f"region_id long, label string, iv array<{INTERVAL}>")
    assert hic.bin_pairs(pairs, 10, compat=True).first().bin_a == 2 and hic.bin_pairs(pairs, 10).first().bin_a == 1
    assert hic.dedup(pairs.union(pairs.withColumn("region_id", F.lit(5)))).first().region_id == 0


def test_enrichment(spark):
    rows = spark.createDataFrame([(str(i), float(i % 5 - 1), 1.0, ["x"] if i < 10 else ["y"]) for i in range(40)], "label string, value double, total double, categories array<string>")
    n = {r.category: r.y for r in enrichment.statistic(rows, "n").collect()}
    assert n == {"x": 6.0, "y": 18.0}
    p = enrichment.empirical(rows, "sum", permutations=20, seed=2).collect()
    assert all(0 <= r.p <= 1 for r in p)
    q = enrichment.adjusted(spark.createDataFrame([("a", 0.01), ("b", 0.5), ("c", 0.02)], "category string, p double")).orderBy("p").collect()
    assert q[0].q == 0 and q[0].fdr <= q[1].fdr <= q[2].fdr


def test_one_region_as_long_as_its_chromosome(spark):
    """Short regions, some of middle lengths and one of 200 million positions: every pair once, without rows for all its bins."""
    r = random.Random(11)
    rows = [(i, "_", [("chr1", "+", s := r.randrange(1, 200_000_000), s + r.choice([0, 40, 511, 512, 5_000, 70_000, 3_000_000]))]) for i in range(400)]
    rows += [(1000, "_", [("chr1", "+", 1, 200_000_000)]), (1001, "_", [("chr1", "+", 5, 9), ("chr1", "+", 150_000_000, 150_000_009)])]
    frame = spark.createDataFrame(rows, "region_id long, label string, iv array<struct<chrom:string,strand:string,start:long,stop:long>>")
    got = Counter(tuple(x) for x in interval_join(frame, frame).selectExpr("t.region_id", "r.region_id").collect())
    want = Counter((i, j) for i, _, a in rows for j, _, b in rows if any(x[2] <= y[3] and x[3] >= y[2] for x in a for y in b))
    assert got == want
    assert joins._binned(joins.flat(frame), "t", ["chrom"], list(joins.LEVELS), None).count() < 402 * 12


def test_tiles_agree_with_plain_windows(spark):
    """Runs, gaps, predecessors and pieces over many tiles, with a region as long as its chromosome's first half."""
    rng = random.Random(3)
    rows = [(0, "l", "chr1", "+", 1, 1_500_000)] + [(i, "l", f"chr{rng.randrange(2)}", "+-"[rng.randrange(2)], s := rng.randrange(1, 3_000_000), s + rng.randrange(1, 9_000)) for i in range(1, 500)]
    df = spark.createDataFrame(rows, "region_id long, label string, chrom string, strand string, start long, stop long")
    df = df.selectExpr("region_id", "label", "array(named_struct('chrom', chrom, 'strand', strand, 'start', start, 'stop', stop)) AS iv")
    groups = {}
    for r in rows:
        groups.setdefault(r[2:4], []).append(r)
    runs, gaps, dists, pieces, chosen = set(), set(), [], set(), set()
    for key, g in groups.items():
        merged = []
        for r in sorted(g, key=lambda r: (r[4], r[5], r[0])):
            if merged and r[4] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], r[5])
            else:
                merged.append([r[4], r[5]])
        runs |= {(*key, a, b) for a, b in merged}
        edges = [0, *(x for m in merged for x in m), 4_000_001]
        gaps |= {(*key, a + 1, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if a + 1 < b}
        o = sorted(g, key=lambda r: (r[4], -r[5], r[0]))
        dists += [(b[0], float(b[4] - a[4])) for a, b in zip(o, o[1:], strict=False)]
        cuts = sorted({x for r in g for x in (r[4], r[5] + 1)})
        pieces |= {(*key, a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False) if any(r[4] <= a and b - 1 <= r[5] for r in g)}
        last = 0
        for r in sorted(g, key=lambda r: (r[4], r[5], r[0])):
            if r[4] > last:
                chosen.add(r[0])
                last = r[5]
    flat = lambda d: {(r.iv[0].chrom, r.iv[0].strand, r.iv[0].start, r.iv[0].stop) for r in d.collect()}
    genome = spark.createDataFrame([("chr0", 4_000_000), ("chr1", 4_000_000)], "chrom string, length long")
    assert flat(sets.link(df)) == runs and flat(sets.inv(df, genome)) == gaps and flat(sets.partition(df)) == pieces
    assert sorted((r.region_id, r.distance) for r in sets.gdist(df).where("NOT isnan(distance)").collect()) == sorted(dists)
    assert {r.region_id for r in sets.cluster(df).collect()} == chosen


def test_shared_parts(spark):
    iv = lambda *xs: [("chr1", "+", a, b) for a, b in xs]
    df = spark.createDataFrame([(1, "a", iv((10, 20), (30, 40)), iv((15, 32), (38, 60))), (2, "b", iv((1, 5)), iv((7, 9)))], f"region_id long, label string, iv array<{INTERVAL}>, other array<{INTERVAL}>")
    got = lambda d: {r.region_id: [(x.start, x.stop) for x in r.iv] for r in d.collect()}
    assert got(regions.meet(df)) == {1: [(15, 20), (30, 32), (38, 40)]}
    assert got(regions.clip(df)) == {1: [(15, 20), (30, 40)]}
    assert got(regions.between(df)) == {1: [(33, 9)], 2: [(10, 0)]}
    cover = overlaps.per_test_coverage(df.drop("other"), df.selectExpr("region_id", "label", "other AS iv"))
    assert {r.region_id: r.coverage for r in cover.collect()} == {1: 6 + 3 + 3}


def test_relations(spark):
    import numpy as np

    a, b = [1.0, 2.0, 4.0, 0.0], [2.0, 1.0, 5.0, 3.0]
    got = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").selectExpr(*(f"{vec_sql.relation(k)} AS {k}" for k in vec_sql.RELATIONS)).first().asDict()
    x, y = np.array(a), np.array(b)
    p, q = x / x.sum(), y / y.sum()
    want = {"inner": x @ y, "covariance": x @ y / 4, "euclid": np.linalg.norm(x - y), "pearson": np.corrcoef(x, y)[0, 1], "relative_entropy": (p[:3] * np.log2(p[:3] / q[:3])).sum(), "chi2": np.sqrt(((x - y) ** 2 / y).sum()), "hamming": 4.0, "jaccard": 2 / 6}
    assert got == pytest.approx(want)
    e = spark.createDataFrame([([0.0, 0.1, 1.0, float("nan")],)], "v array<double>").selectExpr(f"{vec_sql.histogram(4)} AS h", f"{vec_sql.entropy(4)} AS e").first()
    assert e.h == [2, 0, 0, 1] and e.e == pytest.approx(-(2 / 3 * np.log(2 / 3) + 1 / 3 * np.log(1 / 3)) / np.log(4))


def test_permuted_fdr(spark):
    """As many permuted p at or below each p, over its rank, as a plain count finds; a planted category stands out."""
    rng = random.Random(1)
    rows = [(f"g{i}", rng.choice([-1.0, 1.0]) if i >= 40 else 1.0, 1.0, ["all", "planted" if i < 40 else f"c{i % 4}"]) for i in range(200)]
    df = spark.createDataFrame(rows, "label string, value double, total double, categories array<string>")
    got = {r.category: r for r in enrichment.permuted_fdr(df, "n", permutations=20, seed=4).collect()}
    chance = [r.y0 for r in enrichment._dealt(df, "n", 20, 4, False, True, True).collect()]
    want, least = {}, None
    order = sorted(got.values(), key=lambda r: (r.p, r.category))
    for k in range(len(order), 0, -1):
        raw = sum(y <= order[k - 1].p for y in chance) / 20 / k
        least = raw if least is None else min(least, raw)
        want[order[k - 1].category] = least
    assert {c: r.fdr for c, r in got.items()} == pytest.approx(want) and got["planted"].fdr < 0.1
    for how in ("t", "corr"):
        p = enrichment.empirical(df.withColumn("total", F.expr("1 + length(label)")), how, permutations=5)
        assert p.where("p BETWEEN 0 AND 1").count() == 6
