"""Answers from sums and sweeps, against plain loops over all pairs."""

import random

from strandmill.functions.regions import INTERVAL
from strandmill.operators import overlaps, profiles

SCHEMA = f"region_id long, label string, iv array<{INTERVAL}>"


def no_join(monkeypatch):
    """Single-interval regions must not be paired."""

    def join(*a, **k):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(overlaps, "interval_join", join)


def some(r, n, longest, strands="+-"):
    """Short and long regions around the seam of two tiles, on two chromosomes."""
    out = []
    for i in range(n):
        a = 65_536 + r.randint(-300, 300)
        out.append((i, "_", [(f"chr{r.randint(0, 1)}", r.choice(strands), a, a + r.choice((0, 3, 40, longest)))]))
    return out


def test_nearest_breakpoints_without_pairs(spark, monkeypatch):
    r = random.Random(1)
    refs, mates = some(r, 60, 70_000), some(r, 60, 30)
    pairs = [(i, "_", [*a[2], *b[2]]) for i, (a, b) in enumerate(zip(mates, some(r, 60, 30)))]
    want = {}
    for i, _, iv in pairs:
        got = []
        for op, other, q in (("3p", "5p", 0), ("3p", "5p", 1), ("5p", "3p", 0), ("5p", "3p", 1)):
            chrom, strand, a, b = iv[q]
            p = a if (strand == "+") == (op == "5p") else b
            got.append(min((p - s if (t == "+") == (other == "5p") else e - p for _, _, [(c, t, s, e)] in refs if c == chrom and s <= p <= e), default=None))
        if any(x is not None for x in got):
            sums = [x + y for x, y in ((got[0], got[1]), (got[2], got[3]), (got[0], got[3]), (got[1], got[2])) if x is not None and y is not None]
            want[i] = (*got, min(sums, default=None))
    df, ref = spark.createDataFrame(pairs, SCHEMA), spark.createDataFrame(refs, SCHEMA)
    # With a breakpoint of two intervals, those alone go through the join.
    wide = spark.createDataFrame([(99, "_", [("chr7", "+", 1, 2), ("chr7", "+", 5, 6)])], SCHEMA)
    more = {x.region_id: tuple(x)[1:6] for x in overlaps.pair_dist(df, ref.union(wide)).collect()}
    no_join(monkeypatch)
    found = {x.region_id: tuple(x)[1:6] for x in overlaps.pair_dist(df, ref).collect()}
    assert found == more == want and len(want) > 30


def test_coverage_of_tests_without_pairs(spark, monkeypatch):
    r = random.Random(2)
    refs, tests = some(r, 60, 70_000), some(r, 60, 70_000)
    refs += [(100 + i, "_", [("chr0", "+", 65_400 + i, 65_450), ("chr0", "+", 65_500, 65_700 + i)]) for i in range(3)]
    tests += [(100, "_", [("chr0", "+", 65_440, 65_460), ("chr0", "+", 65_600, 65_601)]), (101, "_", [("chr9", "+", 1, 5)])]
    shared = lambda t, c, q: sum(max(0, min(x[3], y[3]) - max(x[2], y[2]) + 1) for _, _, iv in refs for x in t for y in iv if x[0] == y[0] and (not q or x[1] == y[1]))
    df, ref = spark.createDataFrame(tests, SCHEMA), spark.createDataFrame(refs, SCHEMA)
    pairs = {x.region_id: x.coverage for x in overlaps.per_test_coverage(df, ref, bits=12).collect()}
    no_join(monkeypatch)
    for stranded in (True, False):
        want = {i: n for i, _, t in tests if (n := shared(t, refs, stranded))}
        assert {x.region_id: x.coverage for x in overlaps.per_test_coverage(df, ref, stranded=stranded).collect()} == want
        assert not stranded or pairs == want


def _plain(tests, refs, up, down, bins, op, stranded):
    rows = {}
    for i, _, [(c, s, a, b)] in refs:
        first, last = (up, down) if s == "+" else (down, up)
        a, b, row = a - first, b + last, [0] * bins
        back = {"1": False, "5p": s == "-", "3p": s == "+"}[op]
        for _, _, [(d, t, x, y)] in tests:
            if c == d and (s == t or not stranded) and x <= b and y >= a:
                z = ((2 * b - x - y) if back else (x + y - 2 * a)) / 2 / (up + down)
                if 0 <= z < 1:
                    row[int(bins * z)] += 1
        rows[i] = row
    return rows


def test_profiles_and_heatmaps_without_pairs(spark, monkeypatch):
    r = random.Random(3)
    refs, tests = some(r, 40, 500), some(r, 80, 90)
    df, ref = spark.createDataFrame(tests, SCHEMA), spark.createDataFrame(refs, SCHEMA)
    two = spark.createDataFrame([(99, "_", [("chr7", "+", 1, 2), ("chr7", "+", 5, 6)])], SCHEMA)
    more = {x.region_id: x.v for x in profiles.heatmap(df, ref.union(two), upstream=100, downstream=57, bins=7).collect()}
    assert more.pop(99) == [0] * 7 and more == _plain(tests, refs, 100, 57, 7, "5p", True)
    no_join(monkeypatch)
    for op, stranded, up, down, bins in (("5p", True, 100, 57, 7), ("3p", False, 300, 500, 20), ("1", True, 0, 3, 10)):
        how = {"upstream": up, "downstream": down, "bins": bins, "op": op, "stranded": stranded}
        want = _plain(tests, refs, up, down, bins, op, stranded)
        assert {x.region_id: x.v for x in profiles.heatmap(df, ref, **how).collect()} == want
        got = [x.value for x in profiles.profile(df, ref, by_refs=False, **how).orderBy("bin").collect()]
        assert got == [sum(c) for c in zip(*want.values())] and sum(got) > 0
