"""Registered queries on whole tables, against their SQL or plain versions."""

from collections import Counter

import duckdb
import pytest

from strandmill.plans import catalogue

SF = "/root/testdata/sf0.001"


def rounded(rows):
    return Counter(tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", ["set_inv", "set_annotator", "set_partition", "ovl_subset", "ovl_subset_inv", "ovl_annotate", "ovl_bin_pairs", "ovl_dist", "scan_counts_ref", "scan_peaks_poisson", "scan_peaks_binomial", "scan_peaks_cbinomial", "app_peakdiff_scan", "reg_non", "enr_n_hyper"])
def test_agrees_with_sql(spark, name):
    # The smallest tables have no window that passes as a peak by the SQL.
    sf = "/root/testdata/sf0.01" if name.startswith("scan_peaks_") else SF
    got = catalogue.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    # The CTEs that aren't used need tables, too.
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'; CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    want = want.fetchall()
    assert want and rounded(map(tuple, got.select(*columns).collect())) == rounded(want)


def test_whole_vectors(spark):
    v = {r.row_id: [float(x) for x in r.v] for r in catalogue.X.vec(spark, SF).collect()}
    want = {(i, j, round(x, 6)) for i, w in v.items() for j, x in enumerate(w + [y for j in range(1, len(w)) for y in (w[j] / w[0] - 1, w[j] / w[j - 1] - 1)])}
    assert {(r.row_id, r.j) for r in catalogue.queries()["vec_fold"](spark, SF).collect()} == {(i, j) for i, j, _ in want}
    got = catalogue.queries()["mat_rel_all"](spark, SF).where("row_id < 3").collect()
    for i in range(3):
        if i in v:
            mine = [r.x for r in sorted((r for r in got if r.row_id == i), key=lambda r: r.j)]
            assert mine == pytest.approx([y / x for k, x in enumerate(v[i]) for y in v[i][k + 1 :]], abs=1e-5, rel=1e-5)


def test_no_read_lies_behind_the_genome(spark, tmp_path):
    """Parts and customers of a larger scale: reads to 1,000,000 and more, mates to 145,000."""
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    line.selectExpr(*("cast(20001 - l_partkey AS bigint) AS l_partkey" if c == "l_partkey" else c for c in line.columns)).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.selectExpr(*("cast(15001 - o_custkey AS bigint) AS o_custkey" if c == "o_custkey" else c for c in orders.columns)).write.parquet(f"{tmp_path}/orders.parquet")
    q = catalogue.queries()
    assert q["scan_counts_dense"](spark, str(tmp_path)).groupBy().sum("n").first()[0] == line.count()
    reach = catalogue.X.genome(spark, catalogue.X.reads(spark, str(tmp_path))).first().length
    assert 1_000_000 < reach < 1_010_000 and catalogue.X.genome(spark, catalogue.X.reads(spark, SF)).first().length == catalogue.X.LENGTH
    mates = catalogue.X.hic_reads(spark, str(tmp_path)).selectExpr("CASE WHEN strand = '+' THEN start ELSE stop END AS p", "chrom")
    assert mates.where("p > 27 * 4000").count() > 0
    sure, gap = Counter(), set()
    for r in catalogue.X.hic_reads(spark, str(tmp_path)).where("chrom <> '*' AND NOT multi").collect():
        sure[r.read_id] += 1
        if ((r.start if r.strand == "+" else r.stop) - 1) % 4000 >= 3990:
            gap.add(r.read_id)
    got = q["hic_filter"](spark, str(tmp_path)).where("class = 'no-fragment'").collect()
    assert {r.read_id for r in got} == {i for i in gap if sure[i] == 2}
