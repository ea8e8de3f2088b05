"""Pairs of vectors in blocks."""

from strandmill.operators import vectors


def test_every_pair_once_and_no_side_on_the_driver(spark):
    rows = [(k * 37 % 101, None if k % 9 == 0 else f"L{k}", None if k % 7 == 0 else [float(k), 1.0]) for k in range(101)]
    rows += [(5, "again", [0.5]), (None, "none", [1.0])]
    df = spark.createDataFrame(rows, "row_id long, label string, v array<double>")
    for block in (1, 8, 500):
        got = sorted(((*map(str, r.i), *map(str, r.j)) for r in vectors.pairs(df, block).collect()))
        want = sorted((*map(str, a), *map(str, b)) for a in rows for b in rows if a[0] is not None and b[0] is not None and a[0] < b[0])
        assert got == want
    sums = vectors.pairs(df, 8).groupBy("i.row_id").count()
    sums.collect()
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "vs" not in plan  # vectors don't travel where only ids are asked for


def test_sparse_text_rounds_exact_values(spark, tmp_path):
    """Halves of the last digit, numbers just below one by their exact value, and a vector of zeros, as in the SQL."""
    import duckdb

    from strandmill.plans import catalogue

    values = [[1 / 128, -3 / 128, 0.0], [0.0, 0.0, 0.0], [0.1234565, 1e-9, 2.5e8]]
    # Floats of the driver's table are wider here, so that 0.1234565 stays what it is.
    spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'; CREATE TABLE orders AS SELECT * FROM '/root/testdata/sf0.001/orders.parquet'; CREATE TABLE lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'; CREATE TABLE part AS SELECT * FROM '/root/testdata/sf0.001/part.parquet'")
    for name in ("vec_sparse", "mat_sparse"):
        want = sorted(con.execute(catalogue.oracle_sql()[name]).fetchall())
        assert sorted((r.row_id, r.text) for r in catalogue.queries()[name](spark, str(tmp_path)).select("row_id", "text").collect()) == want
    assert want[0] == (0, "0:0.007812 1:-0.023438")
    df = spark.createDataFrame([(1, "a", [None, float("nan"), 2.0]), (2, "b", None)], "row_id long, label string, v array<double>")
    assert {r.row_id: r.text for r in vectors.sparse(df, 1).collect()} == {1: "3:2.000000", 2: None}


def test_both_ends_of_pairs_go_through_one_join(spark, monkeypatch):
    import random

    from strandmill.functions.regions import INTERVAL
    from strandmill.operators import overlaps

    r, calls, join = random.Random(4), [], overlaps.interval_join
    monkeypatch.setattr(overlaps, "interval_join", lambda *a, **k: calls.append(1) or join(*a, **k))
    one = lambda longest: (f"chr{r.randint(0, 1)}", r.choice("+-"), a := 500 + r.randint(-90, 90), a + r.choice((0, 9, longest)))
    # Ids come twice, some are null, and not every row is a pair.
    pairs = [(None if i % 13 == 0 else i % 30, "_", [one(20) for _ in range(1 if i % 11 == 0 else 2)]) for i in range(40)]
    refs = [(None if i == 7 else i, "_", [one(700)]) for i in range(25)]
    df, ref = (spark.createDataFrame(x, f"region_id long, label string, iv array<{INTERVAL}>") for x in (pairs, refs))
    for stranded in (True, False):
        meet = lambda x, y, q=stranded: x[0] == y[0] and (not q or x[1] == y[1]) and x[2] <= y[3] and x[3] >= y[2]
        sides = [[(i, j) for i, _, iv in pairs if i is not None and len(iv) == 2 for j, _, [y] in refs if meet(iv[k], y)] for k in (0, 1)]
        want = sorted((str(i), str(a), str(b)) for i, a in sides[0] for h, b in sides[1] if h == i)
        assert sorted(tuple(map(str, x)) for x in overlaps.bin_pairs(df, ref, stranded=stranded).collect()) == want and len(want) > 30
    assert len(calls) == 2


def test_pairs_of_regions_without_broadcast_or_functions_over_arrays(spark):
    """The plain cases run in compiled code: a merge, no second join for a region's size, no function over arrays."""
    from strandmill.plans import catalogue

    for name, functions in (("ovl_overlap", ""), ("ovl_overlap_spliced", "exists("), ("ovl_annotate", "aggregate(")):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        joins = plan.count("Join")
        assert "BroadcastHashJoin [chrom" not in plan and "SortMergeJoin [chrom" in plan
        assert not functions or functions not in plan
        assert name != "ovl_annotate" or "Join [ref_id" not in plan, joins


def test_few_and_many_intervals_meet_alike(spark, monkeypatch):
    import random

    from strandmill.functions.regions import INTERVAL
    from strandmill.operators import interval_join, overlaps

    r = random.Random(5)

    def some(n, most):
        out = []
        for i in range(n):
            a, iv = 480 + r.randint(0, 60), []
            for _ in range(r.randint(1, most)):
                iv.append(("chr1", "+", a, a + r.randint(0, 4)))
                a += r.randint(5, 12)
            out.append((i, "_", iv))
        return out

    for most_t, most_r in ((1, 3), (3, 1), (3, 4), (5, 6)):
        tests, refs = some(40, most_t), some(40, most_r)
        df, ref = (spark.createDataFrame(x, f"region_id long, label string, iv array<{INTERVAL}>") for x in (tests, refs))
        want = sorted((i, j) for i, _, t in tests for j, _, u in refs if any(x[2] <= y[3] and x[3] >= y[2] for x in t for y in u))
        clipped = sorted((i, j, *x[:2], max(x[2], u[0][2]), min(x[3], u[-1][3])) for i, j in want for t, u in [(tests[i][2], refs[j][2])] for x in t if max(x[2], u[0][2]) <= min(x[3], u[-1][3]))
        for limit in (16, 0):
            monkeypatch.setattr(interval_join, "UNROLLED", limit)
            assert sorted((x.region_id, x.ref_id) for x in overlaps.overlap(df, ref).collect()) == want and want
            assert sorted((x.region_id, x.ref_id, *y) for x in overlaps.intersect(df, ref).collect() for y in x.iv) == clipped


def test_fractions_of_offsets_in_compiled_code(spark):
    """Sizes of single intervals call no function over arrays, those of several still count; rounding is the SQL's, without a text for each number."""
    import duckdb

    from strandmill.functions.regions import INTERVAL
    from strandmill.operators import overlaps
    from strandmill.plans import catalogue

    sf = "/root/testdata/sf0.001"
    got = catalogue.queries()["ovl_offset_frac"](spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "round(" not in plan
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(catalogue.oracle_sql()["ovl_offset_frac"]).fetchall())
    # Ties of the last digit, and either sign.
    values = [k / 128 + 1e-6 * n for k in range(-300, 300, 7) for n in (0, 1, 3)] + [0.0, -1 / 3, 5e-7, -5e-7, 12345.6789015]
    want = [x for (x,) in con.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").coalesce(1).selectExpr(catalogue._ROUND6("x")).collect()] == want
    df, ref = (spark.createDataFrame(x, f"region_id long, label string, iv array<{INTERVAL}>") for x in ([(1, "_", [("chr1", "+", 25, 30)])], [(7, "_", [("chr1", "+", 21, 30), ("chr1", "+", 41, 70)]), (8, "_", [("chr1", "+", 21, 28)])]))
    assert sorted(map(tuple, overlaps.offset(df, ref, fraction=True).collect())) == [(1, 7, 0.1, 0.225), (1, 8, 0.5, 1.125)]
