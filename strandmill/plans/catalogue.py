"""All registered queries and their SQL, by name."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandmill.functions import vectors as vec_sql
from strandmill.operators import enrichment, hic, matrix, overlaps, profiles, regions, scans, sets, vectors
from strandmill.plans import fixtures as X
from strandmill.sources import formats

Q: dict = {}
S: dict = {}


def _add(name, query, sql=None):
    Q[name] = query
    if sql is not None:
        ctes, _, final = sql.rpartition("SELECT_")
        S[name] = X.CTES + (f"{ctes.strip()}\n" if ctes.strip() else "_u AS (SELECT 1)\n") + "SELECT " + final.strip()


def _long(df):
    """A row for each interval."""
    return df.select("region_id", F.posexplode("iv").alias("k", "x")).selectExpr("region_id", "cast(k as bigint) AS k", "x.chrom", "x.strand", "x.start", "x.stop")


def _one(df, *more):
    return df.selectExpr("region_id", *more, "iv[0].chrom AS chrom", "iv[0].strand AS strand", "iv[0].start AS start", "iv[0].stop AS stop")


def _reg(name, op, sql, source=X.spliced):
    _add(f"reg_{name}", lambda s, d: _long(op(source(s, d))), sql)


IV = "region_id, k, chrom, strand, "
_reg("center", regions.center, f"SELECT_ {IV} start + (stop - start) // 2 AS start, stop - (stop - start) // 2 AS stop FROM spl")
_reg("connect", regions.connect, "SELECT_ region_id, 0::BIGINT AS k, chrom, strand, min(start) AS start, max(stop) AS stop FROM spl GROUP BY region_id, chrom, strand")
_reg("diff", regions.diff, "SELECT_ region_id, row_number() OVER (PARTITION BY region_id ORDER BY k) - 1 AS k, chrom, strand, prev + 1 AS start, start - 1 AS stop FROM (SELECT *, lag(stop) OVER (PARTITION BY region_id ORDER BY k) AS prev FROM spl) WHERE prev + 1 <= start - 1")
_add("reg_dist", lambda s, d: regions.dist(X.spliced(s, d), "5p", "3p").select("region_id", F.posexplode("distances").alias("k", "distance")).withColumn("k", F.col("k").cast("long")),
     "SELECT_ region_id, k - 1 AS k, p3 - lag_p5 AS distance FROM (SELECT *, CASE WHEN strand = '+' THEN stop ELSE start END AS p3, lag(CASE WHEN strand = '+' THEN start ELSE stop END) OVER (PARTITION BY region_id ORDER BY k) AS lag_p5 FROM spl) WHERE lag_p5 IS NOT NULL")
_reg("divide", regions.divide, f"SELECT_ region_id, k * 2 + h AS k, chrom, strand, CASE WHEN h = 0 THEN start ELSE start + (stop - start + 1) // 2 END AS start, CASE WHEN h = 0 THEN start + (stop - start + 1) // 2 - 1 ELSE stop END AS stop FROM spl, range(2) t(h)")
_reg("fix", lambda df: regions.fix(regions.shift(df, -50_000, -50_100)), "f AS (SELECT region_id, k AS k0, chrom, strand, start - 50000 AS start, stop - 50100 AS stop FROM spl) SELECT_ region_id, row_number() OVER (PARTITION BY region_id ORDER BY k0) - 1 AS k, chrom, strand, start, stop FROM f WHERE start >= 1 AND start <= stop")
_reg("int", regions.intersection, "SELECT_ region_id, 0::BIGINT AS k, chrom, strand, max(start) AS start, min(stop) AS stop FROM spl GROUP BY region_id, chrom, strand HAVING max(start) <= min(stop)")
_add("reg_n", lambda s, d: regions.n(X.spliced(s, d)).select("region_id", "n"), "SELECT_ region_id, sum(stop - start + 1)::BIGINT AS n FROM spl GROUP BY region_id")
_reg("pos_5p", lambda df: regions.pos(df, "5p", 10), f"SELECT_ {IV} CASE WHEN strand = '+' THEN start ELSE stop - 10 END AS start, CASE WHEN strand = '+' THEN start + 10 ELSE stop END AS stop FROM spl")
_reg("pos_2", lambda df: regions.pos(df, "2", 5), f"SELECT_ {IV} stop - 5 AS start, stop FROM spl")
_reg("pos_c", lambda df: regions.pos(df, "c", 20), f"SELECT_ {IV} start + (stop - start + 1) // 2 - 20 AS start, start + (stop - start + 1) // 2 + 20 AS stop FROM spl")
_reg("shift", lambda df: regions.shift(df, -7, 9), f"SELECT_ {IV} start - 7 AS start, stop + 9 AS stop FROM spl")
_reg("shiftp", lambda df: regions.shiftp(df, -10, 20), f"SELECT_ {IV} CASE WHEN strand = '-' THEN start - 20 ELSE start - 10 END AS start, CASE WHEN strand = '-' THEN stop + 10 ELSE stop + 20 END AS stop FROM spl")
_reg("select_5p", lambda df: regions.select(df, five=True), "SELECT_ region_id, 0::BIGINT AS k, chrom, strand, start, stop FROM (SELECT *, max(k) OVER (PARTITION BY region_id) AS m FROM spl) WHERE k = CASE WHEN strand = '+' THEN 0 ELSE m END")
_reg("select_ends", lambda df: regions.select(df, first=True, last=True), "SELECT_ region_id, CASE WHEN k = 0 THEN 0 ELSE 1 END::BIGINT AS k, chrom, strand, start, stop FROM (SELECT *, max(k) OVER (PARTITION BY region_id) AS m FROM spl) WHERE k IN (0, m)")
_reg("sort", lambda df: regions.sort(df.withColumn("iv", F.reverse("iv"))), f"SELECT_ region_id, k, chrom, strand, start, stop FROM spl")
_add("reg_split", lambda s, d: _one(regions.split(X.spliced(s, d)), "cast(part as bigint) AS part"), "SELECT_ region_id, k AS part, chrom, strand, start, stop FROM spl")
_add("reg_split_chrstrand", lambda s, d: _long(regions.split(X.pairs(s, d), by_chrom_strand=True).withColumn("region_id", F.expr("region_id * 10 + part"))),
     "p AS (SELECT *, chrom_a = chrom_b AND strand_a = strand_b AS same FROM prs) SELECT_ region_id * 10 AS region_id, 0::BIGINT AS k, chrom_a AS chrom, strand_a AS strand, start_a AS start, start_a + 49 AS stop FROM p UNION ALL SELECT region_id * 10 + CASE WHEN same THEN 0 ELSE 1 END, CASE WHEN same THEN 1 ELSE 0 END, chrom_b, strand_b, start_b, start_b + 49 FROM p")
_reg("strand_r", regions.strand, "SELECT_ region_id, k, chrom, CASE WHEN strand = '+' THEN '-' ELSE '+' END AS strand, start, stop FROM spl")
_reg("union", regions.union, "u AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY region_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM spl), r AS (SELECT *, sum(new) OVER (PARTITION BY region_id ORDER BY k) AS run FROM u) SELECT_ region_id, (run - 1)::BIGINT AS k, chrom, strand, min(start) AS start, max(stop) AS stop FROM r GROUP BY region_id, run, chrom, strand")
_add("reg_win", lambda s, d: _one(regions.win(X.refs(s, d), 200, 70), "label"), "SELECT_ region_id, label || '#' || (w + 1) AS label, chrom, strand, start + w * 70 AS start, start + w * 70 + 199 AS stop FROM refs, range(20) t(w) WHERE start + w * 70 + 199 <= stop")
_add("reg_win_small", lambda s, d: _one(regions.win(X.refs(s, d), 200, 70, True), "label"), "SELECT_ region_id, label || '#' || (w + 1) AS label, chrom, strand, start + w * 70 AS start, least(start + w * 70 + 199, stop) AS stop FROM refs, range(20) t(w) WHERE start + w * 70 <= stop")
_add("reg_bounds", lambda s, d: _long(regions.bounds(regions.shift(X.spliced(s, d), -200, 9800), X.genome(s).where("chrom <> 'chr3'"))),
     "f AS (SELECT region_id, k AS k0, chrom, strand, greatest(start - 200, 1) AS start, least(stop + 9800, 110000) AS stop FROM spl WHERE chrom <> 'chr3') SELECT_ region_id, row_number() OVER (PARTITION BY region_id ORDER BY k0) - 1 AS k, chrom, strand, start, stop FROM f WHERE start <= stop")
_add("reg_chrom", lambda s, d: _long(regions.chrom(X.spliced(s, d), s.createDataFrame([("chr1", "I"), ("chr2", "II")], "old string, new string"))), "SELECT_ region_id, k, CASE chrom WHEN 'chr1' THEN 'I' WHEN 'chr2' THEN 'II' ELSE chrom END AS chrom, strand, start, stop FROM spl")
_add("reg_rc", lambda s, d: _long(regions.rc(X.spliced(s, d), X.genome(s))), f"SELECT_ {IV} CASE WHEN strand = '-' THEN 110001 - stop ELSE start END AS start, CASE WHEN strand = '-' THEN 110001 - start ELSE stop END AS stop FROM spl")
_add("reg_rnd", lambda s, d: _long(regions.rnd(X.spliced(s, d), X.genome(s), 7)))
_add("reg_shuffle", lambda s, d: _one(regions.shuffle(X.tests(s, d), X.refs(s, d), 7)))
_add("reg_bed", lambda s, d: formats.as_bed(X.spliced(s, d, apart=True)),
     "g AS (SELECT region_id, chrom, strand, count(*) AS n, min(start) AS s, max(stop) AS e, string_agg((stop - start + 1)::VARCHAR, ',' ORDER BY k) AS sizes, string_agg((start - k * ((region_id % 7) * 60 + 300) - start + k * ((region_id % 7) * 60 + 300))::VARCHAR, ',') AS z, string_agg((k * ((region_id % 7) * 60 + 300))::VARCHAR, ',' ORDER BY k) AS offs FROM apart GROUP BY region_id, chrom, strand) SELECT_ region_id, concat_ws(chr(9), chrom, s - 1, e, 'r' || region_id, 1000, strand) || CASE WHEN n = 1 THEN '' ELSE chr(9) || concat_ws(chr(9), s - 1, e, '0,0,0', n, sizes, offs) END AS value FROM g")
_add("reg_reg", lambda s, d: formats.as_reg(X.spliced(s, d)), "SELECT_ region_id, 'r' || region_id || chr(9) || string_agg(concat_ws(' ', chrom, strand, start, stop), ' ' ORDER BY k) AS value FROM spl GROUP BY region_id")
_add("reg_reg_compact", lambda s, d: formats.as_reg(X.spliced(s, d), True), "SELECT_ region_id, 'r' || region_id || chr(9) || concat_ws(' ', chrom, strand, string_agg(start::VARCHAR, ',' ORDER BY k), string_agg(stop::VARCHAR, ',' ORDER BY k)) AS value FROM spl GROUP BY region_id, chrom, strand")
_add("reg_wig", lambda s, d: formats.as_wig(X.tests(s, d)), "SELECT_ chrom, start, start || ' ' || printf('%.6e', label::DOUBLE) AS value FROM tests UNION ALL SELECT chrom, min(start), 'variableStep chrom=' || chrom || ' span=1' FROM tests GROUP BY chrom")


def _sequences(spark, length=X.CHROMS * 27 * 4096 // X.CHROMS):
    """A made-up genome in chunks: base p (from 1) of chromosome c is B[h % 33 % 5], h the upper bits of a product."""
    base = "element_at(array('A', 'C', 'G', 'T', 'N'), cast(shiftright(((p - 1) * 2654435761 + c * 40503) % 4294967296, 12) % 33 % 5 as int) + 1)"
    return spark.range(X.CHROMS * -(-length // 4096)).selectExpr(f"id % {X.CHROMS} AS c", f"id div {X.CHROMS} AS chunk_no").selectExpr("concat('chr', c) AS chrom", "chunk_no", f"array_join(transform(sequence(chunk_no * 4096 + 1, chunk_no * 4096 + 4096), p -> {base}), '') AS seq")


def _dna(source: str) -> str:
    """SQL: ``seqs``, the spliced sequence of each region, reverse-complemented on '-'."""
    base = "substr('ACGTN', 1 + (((p - 1) * 2654435761 + right(chrom, 1)::BIGINT * 40503) % 4294967296 >> 12) % 33 % 5, 1)"
    return (f"prt AS (SELECT *, array_to_string(list_transform(generate_series(start, stop), lambda p: {base}), '') AS part FROM (SELECT *, 0 AS k FROM {source})), " if source != "spl" else f"prt AS (SELECT *, array_to_string(list_transform(generate_series(start, stop), lambda p: {base}), '') AS part FROM spl), ") + (
        "seqs AS (SELECT region_id, any_value(chrom) AS chrom, any_value(strand) AS strand, min(start) AS start, max(stop) AS stop, CASE WHEN any_value(strand) = '-' THEN reverse(translate(string_agg(part, '' ORDER BY k), 'ACGT', 'TGCA')) ELSE string_agg(part, '' ORDER BY k) END AS seq FROM prt GROUP BY region_id)")


_add("reg_x", lambda s, d: regions.extract(X.spliced(s, d), _sequences(s)).select("region_id", "seq"), _dna("spl") + " SELECT_ region_id, seq FROM seqs")
_PLACED = "chrom, strand, CASE WHEN strand = '-' THEN stop - i0 - len + 2 ELSE start + i0 - 1 END AS start, CASE WHEN strand = '-' THEN stop - i0 + 1 ELSE start + i0 + len - 2 END AS stop"
_add("reg_search", lambda s, d: _one(regions.search(regions.extract(X.refs(s, d), _sequences(s)), "ACGN|TTNA")),
     _dna("refs") + ", h AS (SELECT *, unnest(list_filter(range(1, 498), lambda i: regexp_full_match(substr(seq, i, 4), 'ACG.|TT.A'))) AS i0, 4 AS len FROM seqs) SELECT_ region_id, " + _PLACED + " FROM h")
_add("reg_non", lambda s, d: regions.no_n(regions.extract(X.refs(s, d), _sequences(s))).selectExpr("region_id", "iv[0].chrom AS chrom", "iv[0].strand AS strand", "iv[0].start AS start", "iv[0].stop AS stop", "seq"),
     _dna("refs") + ", h AS (SELECT *, unnest(list_filter(range(1, 501), lambda i: seq[i] <> 'N' AND (i = 1 OR seq[i - 1] = 'N'))) AS i0 FROM seqs), r AS (SELECT *, regexp_extract(substr(seq, i0), '^[^N]+') AS run FROM h), l AS (SELECT *, length(run) AS len FROM r) SELECT_ region_id, " + _PLACED + ", run AS seq FROM l")
_add("reg_len", lambda s, d: regions.length_without_n(regions.extract(X.spliced(s, d), _sequences(s))).select("region_id", "n"), _dna("spl") + " SELECT_ region_id, length(replace(seq, 'N', ''))::INTEGER AS n FROM seqs")
_add("reg_verify", lambda s, d: regions.verify(regions.extract(X.refs(s, d).selectExpr("region_id", "'ACGT' AS label", "transform(iv, x -> named_struct('chrom', x.chrom, 'strand', x.strand, 'start', x.start, 'stop', x.start + 3)) AS iv"), _sequences(s))).select("region_id", "forward", "backward"),
     "four AS (SELECT region_id, chrom, strand, start, start + 3 AS stop FROM refs), " + _dna("four") + " SELECT_ region_id, seq = 'ACGT' AS forward, reverse(translate(seq, 'ACGT', 'TGCA')) = 'ACGT' AS backward FROM seqs")


def _align(s, d):
    r = regions.extract(X.refs(s, d), _sequences(s)).withColumn("ref", F.expr("substring(seq, 1, 100)"))
    sam = "named_struct('qual', repeat('I', 98), 'cigar', array(named_struct('len', 50L, 'op', 'M'), named_struct('len', 2L, 'op', 'D'), named_struct('len', 48L, 'op', 'M')))"
    return formats.align(r.withColumns({"seq": F.expr("concat(substring(ref, 1, 50), substring(ref, 53, 47), 'A')"), "sam": F.expr(sam)}))


_add("reg_align", _align)

FLAT = "region_id, chrom, strand, start, stop"
_add("set_gsort", lambda s, d: _one(sets.gsort(X.tests(s, d))), f"SELECT_ {FLAT} FROM tests")
_RUNS = "u AS (SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY chrom, strand ORDER BY start, stop, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {d} THEN 0 ELSE 1 END AS new FROM {t}), w AS (SELECT *, sum(new) OVER (PARTITION BY chrom, strand ORDER BY start, stop, region_id) AS run FROM u) "
_ALL = "t2 AS (SELECT * FROM tests), "

_add("set_link", lambda s, d: _one(sets.link(X.tests(s, d), distance=3)), _RUNS.format(d=3, t="tests") + "SELECT_ min(region_id) AS region_id, chrom, strand, min(start) AS start, max(stop) AS stop FROM w GROUP BY chrom, strand, run")
_add("set_link_sum", lambda s, d: _one(sets.link(X.tests(s, d), label="sum"), "label"), _RUNS.format(d=0, t="tests") + "SELECT_ min(region_id) AS region_id, sum(label::DOUBLE)::VARCHAR AS label, chrom, strand, min(start) AS start, max(stop) AS stop FROM w GROUP BY chrom, strand, run")
_add("set_inv", lambda s, d: _one(sets.inv(X.tests(s, d), X.genome(s))).drop("region_id"),
     _ALL + _RUNS.format(d=0, t="t2") + ", m AS (SELECT chrom, strand, min(start) AS s, max(stop) AS e FROM w GROUP BY chrom, strand, run), n AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY chrom, strand ORDER BY s), 0) AS p, lead(s) OVER (PARTITION BY chrom, strand ORDER BY s) IS NULL AS last FROM m), g AS (SELECT chrom, strand, p + 1 AS start, s - 1 AS stop FROM n UNION ALL SELECT chrom, strand, e + 1, 110000 FROM n WHERE last) SELECT_ * FROM g WHERE start <= stop")
_add("set_gdist", lambda s, d: sets.gdist(X.tests(s, d), op1="2", op2="1"),
     "o AS (SELECT *, lag(region_id) OVER g AS prev_id, lag(chrom || strand) OVER g AS pk, lag(stop) OVER g AS ps FROM tests WINDOW g AS (ORDER BY chrom, strand, start, stop DESC, region_id)) SELECT_ prev_id, region_id, CASE WHEN pk = chrom || strand THEN (start - ps)::DOUBLE ELSE 'NaN'::DOUBLE END AS distance FROM o WHERE prev_id IS NOT NULL")
_add("set_test", lambda s, d: sets.test(X.tests(s, d)),
     "o AS (SELECT *, lag(chrom) OVER g AS pc, lag(strand) OVER g AS pst, lag(start) OVER g AS p0, lag(stop) OVER g AS p1 FROM tests WINDOW g AS (ORDER BY region_id)) SELECT_ count(*) FILTER ((chrom, strand, start) < (pc, pst, p0)) AS unsorted, count(*) FILTER (chrom = pc AND strand = pst AND start >= p0 AND stop <= p1) AS inclusions, count(*) FILTER (chrom = pc AND strand = pst AND start <= p1 AND stop >= p0) AS overlaps FROM o WHERE pc IS NOT NULL")
_add("set_annotator", lambda s, d: _one(sets.annotator(X.tests(s, d), 500, 60)),
     _ALL + "f AS (SELECT region_id, chrom, strand, CASE WHEN strand = '+' THEN greatest(start - 500, 1) ELSE stop + 1 END AS start, CASE WHEN strand = '+' THEN start - 1 ELSE stop + 500 END AS stop FROM t2), v AS (SELECT * FROM f WHERE start <= stop), e AS (SELECT a.*, max(b.stop) FILTER (a.strand = '+' AND b.stop < a.stop) AS hi, min(b.start) FILTER (a.strand = '-' AND b.start > a.start) AS lo FROM v a LEFT JOIN v b ON a.chrom = b.chrom AND a.strand = b.strand AND a.region_id <> b.region_id AND a.start <= b.stop AND a.stop >= b.start GROUP BY ALL), z AS (SELECT region_id, chrom, strand, CASE WHEN hi IS NULL THEN start WHEN stop - hi < 60 THEN greatest(1, stop - 59) ELSE hi + 1 END AS start, CASE WHEN lo IS NULL THEN stop WHEN lo - start < 60 THEN start + 59 ELSE lo - 1 END AS stop FROM e) SELECT_ * FROM z WHERE start <= stop")
_add("set_bedgraph", lambda s, d: sets.bedgraph(X.tests(s, d)), "SELECT_ region_id, chrom, start, start AS stop, label FROM tests WHERE strand = '+'")
_add("set_partition", lambda s, d: sets.partition(X.tests(s, d)).selectExpr("iv[0].chrom AS chrom", "iv[0].strand AS strand", "iv[0].start AS start", "iv[0].stop AS stop", "label"),
     _ALL + "c AS (SELECT DISTINCT chrom, strand, unnest([start, stop + 1]) AS pos FROM t2), p AS (SELECT chrom, strand, pos AS start, lead(pos) OVER (PARTITION BY chrom, strand ORDER BY pos) - 1 AS stop FROM c) SELECT_ p.chrom, p.strand, p.start, p.stop, string_agg(t2.label, ',' ORDER BY t2.label) AS label FROM p JOIN t2 ON p.chrom = t2.chrom AND p.strand = t2.strand AND p.start <= t2.stop AND p.stop >= t2.start GROUP BY ALL")
_add("set_rev", lambda s, d: _one(sets.rev(X.tests(s, d))), f"SELECT_ {FLAT} FROM tests")
_add("set_cluster", lambda s, d: _one(sets.cluster(X.tests(s, d))))

MEET = "t.chrom = r.chrom AND t.strand = r.strand AND t.start <= r.stop AND t.stop >= r.start"
_add("ovl_overlap", lambda s, d: overlaps.overlap(X.tests(s, d), X.refs(s, d), label=True).select("region_id", "ref_id", "label"), f"SELECT_ t.region_id, r.region_id AS ref_id, t.label || ':' || r.label AS label FROM tests t JOIN refs r ON {MEET}")
_add("ovl_overlap_unstranded", lambda s, d: overlaps.overlap(X.tests(s, d), X.refs(s, d), stranded=False).select("region_id", "ref_id"), f"SELECT_ t.region_id, r.region_id AS ref_id FROM tests t JOIN refs r ON {MEET.replace('AND t.strand = r.strand ', '')}")
_SPL = "env AS (SELECT region_id, chrom, strand, min(start) AS start, max(stop) AS stop FROM apart GROUP BY ALL), "
_add("ovl_overlap_spliced", lambda s, d: overlaps.overlap(X.tests(s, d), X.spliced(s, d, apart=True)).select("region_id", "ref_id"), f"SELECT_ DISTINCT t.region_id, r.region_id AS ref_id FROM tests t JOIN apart r ON {MEET}")
_add("ovl_overlap_gaps", lambda s, d: overlaps.overlap(X.tests(s, d), X.spliced(s, d, apart=True), gaps=True).select("region_id", "ref_id"), _SPL.rstrip(", ") + f" SELECT_ t.region_id, r.region_id AS ref_id FROM tests t JOIN env r ON {MEET}")
_add("ovl_subset", lambda s, d: _one(overlaps.subset(X.tests(s, d), X.refs(s, d))), _ALL.rstrip(", ") + f" SELECT_ {FLAT} FROM tests t WHERE EXISTS (SELECT 1 FROM refs r WHERE {MEET})")
_add("ovl_subset_inv", lambda s, d: _one(overlaps.subset(X.tests(s, d), X.refs(s, d), inverse=True)), _ALL.rstrip(", ") + f" SELECT_ {FLAT} FROM tests t WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE {MEET})")
_add("ovl_intersect", lambda s, d: _one(overlaps.intersect(X.tests(s, d), X.refs(s, d)), "ref_id"), f"SELECT_ t.region_id, r.region_id AS ref_id, t.chrom, t.strand, greatest(t.start, r.start) AS start, least(t.stop, r.stop) AS stop FROM tests t JOIN refs r ON {MEET}")
_add("ovl_count", lambda s, d: overlaps.count(X.reads(s, d), X.refs(s, d)).select("region_id", "hits"), f"h AS (SELECT r.region_id, count(*) AS n FROM reads t JOIN refs r ON {MEET} GROUP BY 1) SELECT_ refs.region_id, coalesce(n, 0)::DOUBLE AS hits FROM refs LEFT JOIN h USING (region_id)")
_add("ovl_count_weighted", lambda s, d: overlaps.count(X.reads(s, d), X.refs(s, d), max_label_value=20, least=5).select("region_id", "hits"), f"h AS (SELECT r.region_id, sum(least(20, t.label::DOUBLE)) AS hits FROM reads t JOIN refs r ON {MEET} GROUP BY 1) SELECT_ region_id, hits FROM h WHERE hits >= 5")
_add("ovl_coverage", lambda s, d: overlaps.coverage(X.reads(s, d), X.spliced(s, d, apart=True)).select("region_id", "bases"), f"h AS (SELECT r.region_id, sum(least(t.stop, r.stop) - greatest(t.start, r.start) + 1) AS n FROM reads t JOIN apart r ON {MEET} GROUP BY 1) SELECT_ o.region_id, coalesce(n, 0)::DOUBLE AS bases FROM refs o LEFT JOIN h USING (region_id)")
_add("ovl_density", lambda s, d: overlaps.density(X.reads(s, d), X.refs(s, d), least=0.01).selectExpr("region_id", "round(density, 6) AS density"), f"h AS (SELECT r.region_id, sum(least(t.stop, r.stop) - greatest(t.start, r.start) + 1) / 500.0 AS y FROM reads t JOIN refs r ON {MEET} GROUP BY 1) SELECT_ region_id, round(y::DOUBLE, 6) AS density FROM h WHERE y >= 0.01")
_add("ovl_rpkm", lambda s, d: overlaps.rpkm(X.reads(s, d), X.refs(s, d)).selectExpr("region_id", "round(rpkm, 4) AS rpkm"), f"h AS (SELECT r.region_id, count(*) AS n FROM reads t JOIN refs r ON {MEET} GROUP BY 1) SELECT_ refs.region_id, round(1000.0 * coalesce(n, 0) / (500 * ((SELECT sum(n) FROM h) / 1e6)), 4) AS rpkm FROM refs LEFT JOIN h USING (region_id)")
_OFF = {"1": ("t.start - r.start", "t.stop - r.start"), "2": ("t.start - r.stop", "t.stop - r.stop"),
        "5p": ("CASE WHEN t.strand = '-' THEN r.stop - t.stop ELSE t.start - r.start END", "CASE WHEN t.strand = '-' THEN r.stop - t.start ELSE t.stop - r.start END"),
        "3p": ("CASE WHEN t.strand = '+' THEN r.stop - t.stop ELSE t.start - r.start END", "CASE WHEN t.strand = '+' THEN r.stop - t.start ELSE t.stop - r.start END")}
for _op, (_a, _b) in _OFF.items():
    _add(f"ovl_offset_{_op}", lambda s, d, op=_op: overlaps.offset(X.tests(s, d), X.refs(s, d), op=op), f"SELECT_ t.region_id, r.region_id AS ref_id, {_a} AS start_offset, {_b} AS stop_offset FROM tests t JOIN refs r ON {MEET}")
#: A double to 6 digits by the SQL's own arithmetic; Spark's ``round`` writes each number out as a text first.
_ROUND6 = "sign({0}) * floor(abs({0}) * 1e6D + 0.5D) / 1e6D".format
_a, _b = _OFF["5p"]
_add("ovl_offset_frac", lambda s, d: overlaps.offset(X.tests(s, d), X.refs(s, d), fraction=True).selectExpr("region_id", "ref_id", f"{_ROUND6('start_offset')} AS start_offset", f"{_ROUND6('stop_offset')} AS stop_offset"), f"SELECT_ t.region_id, r.region_id AS ref_id, round(({_a}) / 500.0::DOUBLE, 6) AS start_offset, round(({_b}) / 500.0::DOUBLE, 6) AS stop_offset FROM tests t JOIN refs r ON {MEET}")
_add("ovl_offset_centre", lambda s, d: overlaps.offset(X.tests(s, d), X.refs(s, d), centre=True).select("region_id", "ref_id", "start_offset"), f"SELECT_ t.region_id, r.region_id AS ref_id, trunc((({_a}) + ({_b})) / 2)::BIGINT AS start_offset FROM tests t JOIN refs r ON {MEET}")
_add("ovl_offset_skipgaps", lambda s, d: overlaps.offset_without_gaps(X.reads(s, d), X.spliced(s, d, apart=True)).selectExpr("region_id", "ref_id", "cast(k as bigint) AS k", "start", "start_offset", "stop_offset"),
     f"e AS (SELECT *, min(start) OVER w AS lo, max(stop) OVER w AS hi, coalesce(sum(start - pstop - 1) OVER (PARTITION BY region_id ORDER BY k), 0) AS before, coalesce(sum(nstart - stop - 1) OVER (PARTITION BY region_id ORDER BY k DESC), 0) AS after FROM (SELECT *, lag(stop) OVER (PARTITION BY region_id ORDER BY k) AS pstop, lead(start) OVER (PARTITION BY region_id ORDER BY k) AS nstart FROM apart) WINDOW w AS (PARTITION BY region_id)) SELECT_ t.region_id, r.region_id AS ref_id, r.k, t.start, (CASE WHEN t.strand = '-' THEN hi - t.stop - after ELSE t.start - lo - before END)::BIGINT AS start_offset, (CASE WHEN t.strand = '-' THEN hi - t.start - after ELSE t.stop - lo - before END)::BIGINT AS stop_offset FROM reads t JOIN e r ON t.chrom = r.chrom AND t.strand = r.strand AND t.start >= r.start AND t.stop <= r.stop AND t.start <= t.stop")
_add("ovl_annotate", lambda s, d: overlaps.annotate(X.tests(s, d), X.tests(s, d), upstream_max=500, upstream_min=60, proximal=100).selectExpr("region_id", "ref_id", "kind", "offset", "round(normalized, 6) AS normalized", "tag"),
     S["set_annotator"][len(X.CTES) :].replace("SELECT * FROM z WHERE start <= stop", f", r2 AS (SELECT * FROM z WHERE start <= stop), j AS (SELECT t.region_id, r.region_id AS ref_id, 'gene' AS kind, ({_OFF['5p'][0]})::DOUBLE AS o, r.stop - r.start + 1 AS size FROM tests t JOIN t2 r ON {MEET} UNION ALL SELECT t.region_id, r.region_id, 'upstream', ({_OFF['3p'][0]})::DOUBLE, r.stop - r.start + 1 FROM tests t JOIN r2 r ON {MEET}) SELECT_ region_id, ref_id, kind, o AS \"offset\", round(o / size, 6) AS normalized, CASE WHEN kind = 'upstream' THEN CASE WHEN o >= 100 THEN 'distal' ELSE 'proximal' END WHEN o > 100 THEN 'distal:downstream' ELSE 'proximal:downstream' END AS tag FROM j"))
_SIDE = "JOIN refs {r} ON p.chrom_{x} = {r}.chrom AND p.strand_{x} = {r}.strand AND p.start_{x} <= {r}.stop AND p.start_{x} + 49 >= {r}.start"
_add("ovl_bin_pairs", lambda s, d: overlaps.bin_pairs(X.pairs(s, d), X.tests(s, d)), f"SELECT_ p.region_id, r1.region_id AS ref_1, r2.region_id AS ref_2 FROM prs p {_SIDE.format(r='r1', x='a')} {_SIDE.format(r='r2', x='b')} WHERE p.region_id % 20 = 1")
S["ovl_bin_pairs"] = X.CTES + _ALL.rstrip(", ") + f" SELECT p.region_id, r1.region_id AS ref_1, r2.region_id AS ref_2 FROM prs p {_SIDE.format(r='r1', x='a')} {_SIDE.format(r='r2', x='b')}".replace("JOIN refs", "JOIN t2")
_P = {(op, x): f"CASE WHEN p.strand_{x} = '{'-' if op == '3p' else '+'}' THEN p.start_{x} ELSE p.start_{x} + 49 END" for op in ("3p", "5p") for x in "ab"}


def _end(k, op, other, x):
    """SQL: the offset of an end from the nearest breakpoint region that holds it, with the sign of the first of equals."""
    point, ref = _P[op, x], "CASE WHEN r.strand = '+' THEN r.start ELSE r.stop END" if other == "5p" else "CASE WHEN r.strand = '+' THEN r.stop ELSE r.start END"
    flip = "r.strand = '-'" if other == "5p" else "r.strand = '+'"
    value = f"CASE WHEN {flip} THEN ({ref}) - ({point}) ELSE ({point}) - ({ref}) END"
    return f"o{k} AS (SELECT p.region_id, arg_min({value}, (abs({value}), {value})) AS o{k} FROM prs p JOIN t2 r ON p.chrom_{x} = r.chrom AND ({point}) BETWEEN r.start AND r.stop GROUP BY 1)"


_ENDS = ", ".join(_end(k, *e) for k, e in enumerate((("3p", "5p", "a"), ("3p", "5p", "b"), ("5p", "3p", "a"), ("5p", "3p", "b"))))
_add("ovl_dist", lambda s, d: overlaps.pair_dist(X.pairs(s, d), X.tests(s, d)),
     _ALL + _ENDS + " SELECT_ p.region_id, o0 AS offset_0, o1 AS offset_1, o2 AS offset_2, o3 AS offset_3, least(o0 + o1, o2 + o3, o0 + o3, o1 + o2) AS least_sum, CASE WHEN chrom_a = chrom_b THEN greatest(start_a, start_b) + 49 - least(start_a, start_b) END AS span FROM prs p LEFT JOIN o0 USING (region_id) LEFT JOIN o1 USING (region_id) LEFT JOIN o2 USING (region_id) LEFT JOIN o3 USING (region_id) WHERE coalesce(o0, o1, o2, o3) IS NOT NULL")
_add("ovl_per_test_count", lambda s, d: overlaps.per_test_count(X.tests(s, d), X.refs(s, d)), f"SELECT_ t.region_id, count(*) AS hits FROM tests t JOIN refs r ON {MEET} GROUP BY 1")

_WIN = "m AS (SELECT t.chrom, strand, (start - 1) // 50 AS b, count(*) AS n FROM reads t WHERE start >= 1 AND (start - 1) // 50 < 2200 GROUP BY ALL), w AS (SELECT chrom, strand, b - h AS k0, sum(n) AS n FROM m, range(10) t(h) WHERE b - h BETWEEN 0 AND 2190 GROUP BY ALL) "
_add("scan_counts", lambda s, d: scans.counts(X.reads(s, d), X.genome(s, X.reads(s, d)), size=500, step=50, least=3), _WIN + "SELECT_ chrom, strand, k0 + 1 AS k, k0 * 50 + 1 AS start, k0 * 50 + 500 AS stop, n::DOUBLE AS n FROM w WHERE n >= 3")
_add("scan_counts_dense", lambda s, d: scans.counts(X.reads(s, d), X.genome(s, X.reads(s, d)), size=500, step=500, least=0, stranded=False), "m AS (SELECT chrom, (start - 1) // 500 AS b, count(*) AS n FROM reads GROUP BY ALL) SELECT_ g.chrom, '+' AS strand, b0 + 1 AS k, b0 * 500 + 1 AS start, b0 * 500 + 500 AS stop, coalesce(n, 0)::DOUBLE AS n FROM genome g CROSS JOIN range(220) t(b0) LEFT JOIN m ON m.chrom = g.chrom AND m.b = b0")
_add("scan_counts_points", lambda s, d: scans.counts(X.reads(s, d), X.genome(s, X.reads(s, d)), size=100, step=100, op="p"), "m AS (SELECT chrom, strand, b, sum(least(stop, (b + 1) * 100) - greatest(start, b * 100 + 1) + 1) AS n FROM reads, range(1100) t(b) WHERE b BETWEEN (start - 1) // 100 AND (stop - 1) // 100 GROUP BY ALL) SELECT_ chrom, strand, b + 1 AS k, b * 100 + 1 AS start, b * 100 + 100 AS stop, n::DOUBLE AS n FROM m WHERE n >= 1")
_add("scan_counts_ref", lambda s, d: scans.counts(X.reads(s, d), X.genome(s, X.reads(s, d)), size=500, step=50, least=3, ref=X.tests(s, d)), _ALL + _WIN + "SELECT_ chrom, strand, k0 + 1 AS k, k0 * 50 + 1 AS start, k0 * 50 + 500 AS stop, n::DOUBLE AS n FROM w WHERE n >= 3 AND EXISTS (SELECT 1 FROM t2 r WHERE r.chrom = w.chrom AND r.strand = w.strand AND r.start <= k0 * 50 + 500 AND r.stop >= k0 * 50 + 1)")


def _split(s, d):
    r = X.reads(s, d)
    return r.where("l_returnflag = 'R'"), r.where("l_returnflag <> 'R'")


def _binomial(k: str, p: str, n: str) -> str:
    """SQL of P(X > k): 400 terms at most, as further ones are far from the mean here."""
    return f"coalesce(list_sum(list_transform(range({k} + 1, least({n}, {k} + 400) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - ({p}))))), 0)"


def _poisson(k: str, mu: str) -> str:
    return f"list_sum(list_transform(range({k} + 1, {k} + 400), lambda i: exp(i * ln({mu}) - {mu} - lgamma(i + 1))))"


def _tail(method: str, x: str, y: str, a: str, b: str) -> str:
    return {
        "binomial": _binomial(x, f"greatest(({y} + 1) / 501.0::DOUBLE, {a}.n / size)", "501"), "poisson": _poisson(f"({x} + 5)", f"({y} + 5.0::DOUBLE)"),
        "binomial2": _binomial(f"({x} + 1)", f"(({y} + 1) / {b}.n::DOUBLE)", f"{a}.n"), "cbinomial": _binomial(f"({x} + 1)", "0.5::DOUBLE", f"({x} + {y} + 2)"),
    }[method]


def _peaks_sql(method: str) -> str:
    """Counts, tails, and the greatest p-value whose rank among those of the null is low enough, all over windows of 500 in steps of 100."""
    side = "{0} AS (SELECT chrom, b - h AS k0, sum(n) AS n FROM (SELECT chrom, (start - 1) // 100 AS b, count(*) AS n FROM reads WHERE l_returnflag {1} 'R' AND start >= 1 AND (start - 1) // 100 < 1100 GROUP BY ALL), range(5) t(h) WHERE b - h BETWEEN 0 AND 1095 GROUP BY ALL), n{0} AS (SELECT count(*) AS n, 1100000::DOUBLE AS size FROM reads WHERE l_returnflag {1} 'R'), "
    return (side.format("wa", "=") + side.format("wb", "<>").replace(", 1100000::DOUBLE AS size", "")
            + "v AS (SELECT wa.chrom, wa.k0, least(wa.n, 500)::BIGINT AS x, least(coalesce(wb.n, 0), 500)::BIGINT AS y FROM wa LEFT JOIN wb USING (chrom, k0) WHERE least(wa.n, 500) >= 1), "
            + f"p AS (SELECT v.*, {_tail(method, 'x', 'y', 'nwa', 'nwb')} AS p1, {_tail(method, 'y', 'x', 'nwb', 'nwa')} AS p2 FROM v, nwa, nwb), f AS (SELECT * FROM p WHERE p1 <= 0.05), "
            + "q AS (SELECT o.p1, (SELECT count(*) FROM f i WHERE i.p1 <= o.p1) AS k, (SELECT count(*) FROM f i WHERE i.p2 <= o.p1) AS z FROM (SELECT DISTINCT p1 FROM f) o) "
            + "SELECT_ chrom, '+' AS strand, k0 * 100 + 1 AS start, k0 * 100 + 500 AS stop, x::DOUBLE AS v1, y::DOUBLE AS v2, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM f WHERE p1 <= (SELECT max(p1) FROM q WHERE z / k <= 0.5 AND k > 1)")


_PEAK = ["chrom", "strand", "start", "stop", "v1", "v2", "round(p1, 6) AS p1", "round(p2, 6) AS p2"]
for _m in ("binomial", "poisson", "binomial2", "cbinomial", "normal"):
    _add(f"scan_peaks_{_m}", lambda s, d, m=_m: scans.peaks(*(lambda a, b: (a, X.genome(s, X.reads(s, d)), b))(*_split(s, d)), size=500, step=100, pval=0.05, qval=0.5, method=m, compare=True).selectExpr(*_PEAK), _peaks_sql(_m) if _m != "normal" else None)
_add("scan_peaks_random", lambda s, d: scans.peaks(X.reads(s, d), X.genome(s, X.reads(s, d)), size=500, step=100, pval=0.05, qval=0.5, seed=3).selectExpr(*_PEAK))

_MID = f"(({_OFF['5p'][0]}) + ({_OFF['5p'][1]})) / 2.0"
_WIDE = "wide AS (SELECT region_id, chrom, strand, start - CASE WHEN strand = '+' THEN 300 ELSE 500 END AS start, stop + CASE WHEN strand = '+' THEN 500 ELSE 300 END AS stop FROM refs), "
_add("app_profile", lambda s, d: profiles.profile(X.tests(s, d), X.refs(s, d), upstream=300, downstream=500, bins=20).selectExpr("bin", "round(value, 9) AS value"),
     _WIDE + f"z AS (SELECT ({_MID}) / 800 AS z FROM tests t JOIN wide r ON {MEET}), h AS (SELECT floor(20 * z)::INTEGER AS bin, count(*) AS n FROM z WHERE z >= 0 AND z < 1 GROUP BY 1) SELECT_ b::INTEGER AS bin, round(coalesce(n, 0) / (SELECT count(*) FROM refs)::DOUBLE, 9) AS value FROM range(20) t(b) LEFT JOIN h ON h.bin = b")
_add("app_heatmap", lambda s, d: profiles.heatmap(X.tests(s, d), X.refs(s, d), upstream=300, downstream=500, bins=8, smooth=1).select("region_id", F.posexplode("v").alias("bin", "value")).selectExpr("region_id", "bin", "round(value, 6) AS value"),
     _WIDE + f"z AS (SELECT r.region_id, floor(8 * ({_MID}) / 800)::INTEGER AS b FROM tests t JOIN wide r ON {MEET} WHERE ({_MID}) / 800 >= 0 AND ({_MID}) / 800 < 1), h AS (SELECT region_id, b, count(*) AS n FROM z GROUP BY ALL), g AS (SELECT refs.region_id, b0::INTEGER AS bin, coalesce(n, 0) AS n FROM refs CROSS JOIN range(8) t(b0) LEFT JOIN h ON h.region_id = refs.region_id AND h.b = b0) SELECT_ region_id, bin, round(avg(n) OVER (PARTITION BY region_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS value FROM g")
_add("app_peakdiff_scan", lambda s, d: profiles.peakdiff_scan({"a": [_split(s, d)[0]], "b": [_split(s, d)[1]]}, X.genome(s, X.reads(s, d)), size=500, step=500, pval=0.01),
     "ca AS (SELECT chrom, (start - 1) // 500 AS k0, count(*) AS n FROM reads WHERE l_returnflag = 'R' GROUP BY ALL), cb AS (SELECT chrom, (start - 1) // 500 AS k0, count(*) AS n FROM reads WHERE l_returnflag <> 'R' GROUP BY ALL), nn AS (SELECT count(*) FILTER (l_returnflag = 'R') / 1100000 AS pa, count(*) FILTER (l_returnflag <> 'R') / 1100000 AS pb FROM reads), "
     "v AS (SELECT chrom, k0, least(coalesce(ca.n, 0), 500) AS x, least(coalesce(cb.n, 0), 500) AS y FROM ca FULL JOIN cb USING (chrom, k0) WHERE k0 BETWEEN 0 AND 219) "
     f"SELECT_ chrom, '+' AS strand, k0 + 1 AS k, k0 * 500 + 1 AS start, k0 * 500 + 500 AS stop, x::DOUBLE AS a_1, y::DOUBLE AS b_1 FROM v, nn WHERE least({_binomial('x', 'pa', '501')}, {_binomial('y', 'pb', '501')}) <= 0.01")
_add("app_peakdiff", lambda s, d: profiles.peakdiff(profiles.peakdiff_scan({"a": [_split(s, d)[0]], "b": [_split(s, d)[1]]}, X.genome(s, X.reads(s, d)), pval=0.5), "a", "b"))

_add("hic_filter", lambda s, d: hic.classify(X.hic_reads(s, d), X.fragments(s, d)).select("read_id", "class"),
     "a AS (SELECT o_orderkey AS read_id, CASE WHEN o_orderkey % 13 = 0 THEN '*' ELSE 'chr' || (o_custkey % 10) END AS ca, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS sa, 1 + (o_orderkey * 7919) % 100000 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 49 END AS pa, o_orderkey % 11 = 0 AS ma, o_orderkey % 17 <> 0 AS mated, CASE WHEN o_custkey % 13 = 0 THEN '*' ELSE 'chr' || (o_custkey % 10) END AS cb, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS sb, 1 + (o_orderkey * 7919) % 100000 + o_custkey * 3 + CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 49 END AS pb, o_custkey % 7 = 0 AS mb FROM orders), "
     "f AS (SELECT *, CASE WHEN (pa - 1) % 4000 < 3990 AND pa <= 27 * 4000 THEN (pa - 1) // 4000 END AS fa, CASE WHEN (pb - 1) % 4000 < 3990 AND pb <= 27 * 4000 THEN (pb - 1) // 4000 END AS fb FROM a), g AS (SELECT *, least(pa - fa * 4000 - 1, fa * 4000 + 3990 - pa) AS oa, least(pb - fb * 4000 - 1, fb * 4000 + 3990 - pb) AS ob FROM f) "
     "SELECT_ read_id, CASE WHEN NOT mated THEN 'unpaired' WHEN ca = '*' AND cb = '*' THEN 'unmapped' WHEN ma AND mb THEN 'multihit' WHEN ca <> '*' AND cb <> '*' AND NOT ma AND NOT mb THEN CASE WHEN fa IS NULL OR fb IS NULL THEN 'no-fragment' WHEN ca = cb AND fa = fb THEN 'same-fragment' WHEN sa <> sb AND abs(pa - pb) < 1000 AND ca = cb THEN 'small-distance' WHEN oa <= 500 AND ob <= 500 THEN 'proximal' ELSE 'distal' END WHEN ca <> '*' OR cb <> '*' THEN 'single' ELSE 'unmapped-multihit' END AS class FROM g")
_add("hic_dedup", lambda s, d: hic.dedup(X.pairs(s, d).union(X.pairs(s, d).withColumn("region_id", F.expr("region_id + 10000000")))).select("region_id"), "SELECT_ min(region_id) AS region_id FROM prs GROUP BY chrom_a, strand_a, start_a, chrom_b, strand_b, start_b")
_add("hic_bin", lambda s, d: hic.bin_pairs(X.pairs(s, d), 10_000, X.genome(s)), "SELECT_ region_id, chrom_a, chrom_b, (start_a - 1) // 10000 + 1 + 12 * right(chrom_a, 1)::BIGINT AS bin_a, (start_b - 1) // 10000 + 1 + 12 * right(chrom_b, 1)::BIGINT AS bin_b FROM prs")
_add("hic_matrix", lambda s, d: hic.bin_pairs(X.pairs(s, d), 10_000, X.genome(s), compat=True, matrix=True),
     "p AS (SELECT start_a // 10000 + 1 + 12 * right(chrom_a, 1)::BIGINT AS a, start_b // 10000 + 1 + 12 * right(chrom_b, 1)::BIGINT AS b FROM prs), u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p WHERE a <> b) SELECT_ a AS bin_a, b AS bin_b, count(*) AS n FROM u GROUP BY ALL")
_add("hic_align_merge", lambda s, d: hic.first_mapped(X.hic_reads(s, d).selectExpr("read_id", "50 - mate * 10 AS length", "chrom")), "t AS (SELECT o_orderkey AS read_id, 50 AS length, CASE WHEN o_orderkey % 13 = 0 THEN '*' ELSE 'chr' || (o_custkey % 10) END AS chrom FROM orders UNION ALL SELECT o_orderkey, 40, CASE WHEN o_custkey % 13 = 0 THEN '*' ELSE 'chr' || (o_custkey % 10) END FROM orders WHERE o_orderkey % 17 <> 0) SELECT_ read_id, length, chrom FROM t QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY chrom = '*', CASE WHEN chrom = '*' THEN length ELSE -length END) = 1")


def _cells(df):
    return df.select("row_id", F.posexplode("v").alias("j", "x")).selectExpr("row_id", "cast(j as bigint) AS j", "round(x, 6) AS x")


def _vec(name, op, sql):
    _add(f"vec_{name}", lambda s, d: _cells(op(X.vec(s, d))), sql)


def _val(name, op, sql, rounded=True):
    value = "round(value, 6) AS value" if rounded else "value"
    _add(f"vec_{name}", lambda s, d: op(X.vec(s, d)).selectExpr("row_id", value), f"SELECT_ row_id, {f'round({sql}, 6)' if rounded else sql} AS value FROM vec")


NUM = "list_aggregate(v, '{}')".format
_val("absmax", vectors.absmax, f"CASE WHEN abs({NUM('max')}) >= abs({NUM('min')}) THEN {NUM('max')} ELSE {NUM('min')} END")
_vec("bins", lambda v: vectors.bins(v, 6, -0.4, 0.4, 2), "z AS (SELECT row_id, floor(6 * ((x + 0.4::DOUBLE) / (0.4::DOUBLE + 0.4::DOUBLE)))::BIGINT // 2 AS b FROM cell WHERE (x + 0.4::DOUBLE) / 0.8::DOUBLE >= 0 AND (x + 0.4::DOUBLE) / 0.8::DOUBLE < 1), h AS (SELECT row_id, b, count(*) AS n FROM z GROUP BY ALL) SELECT_ vec.row_id, k AS j, coalesce(n, 0)::DOUBLE AS x FROM vec CROSS JOIN range(3) t(k) LEFT JOIN h ON h.row_id = vec.row_id AND h.b = k")
_vec("cutoff", lambda v: vectors.cutoff(v, 0.1, -1.0), "SELECT_ row_id, j, round(CASE WHEN x < 0.1 THEN -1 ELSE x END, 6) AS x FROM cell")
_vec("cutoff_upper", lambda v: vectors.cutoff(v, 0.1, 9.0, upper=True), "SELECT_ row_id, j, round(CASE WHEN x > 0.1 THEN 9 ELSE x END, 6) AS x FROM cell")
_vec("div", vectors.div, "SELECT_ c.row_id, c.j - 1 AS j, round(c.x / v[1], 6) AS x FROM cell c JOIN vec USING (row_id) WHERE c.j > 0")
_vec("exp", lambda v: vectors.exp(v, 2.0), "SELECT_ row_id, j, round(pow(2.0::DOUBLE, x), 6) AS x FROM cell")
_vec("log", lambda v: vectors.log(v, 2.0, 1.0), "SELECT_ row_id, j, round(ln(x + 1) / ln(2.0::DOUBLE), 6) AS x FROM cell")
_vec("pow", lambda v: vectors.pow_(v, 3), "SELECT_ row_id, j, round(pow(x, 3), 6) AS x FROM cell")
_vec("fold", vectors.fold, "p AS (SELECT *, lag(x) OVER w AS px, first(x) OVER w AS x0, count(*) OVER (PARTITION BY row_id) AS n FROM cell WINDOW w AS (PARTITION BY row_id ORDER BY j)) SELECT_ row_id, j, round(x, 6) AS x FROM cell UNION ALL SELECT row_id, n + 2 * (j - 1) + h, round(CASE WHEN h = 0 THEN x / x0 ELSE x / px END - 1, 6) FROM p, range(2) t(h) WHERE j > 0")
_add("vec_format", lambda s, d: vectors.format_(X.vec(s, d), "%.3f", ",").select("row_id", "text"), "SELECT_ row_id, string_agg(printf('%.3f', x), ',' ORDER BY j) AS text FROM cell GROUP BY row_id")
_add("vec_hist", lambda s, d: vectors.hist(X.vec(s, d), 10, -0.5, 0.5).selectExpr("bin", "round(start, 6) AS start", "round(fraction, 9) AS fraction", "count"), "h AS (SELECT floor(10 * ((x + 0.5) / 1.0::DOUBLE))::INTEGER AS bin, count(*) AS n FROM cell WHERE x + 0.5 >= 0 AND x + 0.5 < 1 GROUP BY 1) SELECT_ k::INTEGER AS bin, round(-0.5 + k * 0.1::DOUBLE, 6) AS start, round(coalesce(n, 0) / (SELECT sum(n) FROM h)::DOUBLE, 9) AS fraction, coalesce(n, 0) AS count FROM range(10) t(k) LEFT JOIN h ON h.bin = k")
_val("imax", vectors.imax, f"(list_position(v, {NUM('max')}) - 1)::BIGINT", False)
_val("imin", vectors.imin, f"(list_position(v, {NUM('min')}) - 1)::BIGINT", False)
_vec("items", lambda v: vectors.items(v, 10), "SELECT_ row_id, row_number() OVER (PARTITION BY row_id ORDER BY j) - 1 AS j, round(10.0::DOUBLE * j + x, 6) AS x FROM cell WHERE x <> 0")
_val("m", vectors.m, NUM("avg"))
_val("m_trimmed", lambda v: vectors.m(v, 0.1), "list_aggregate(list_sort(v)[floor(0.1::DOUBLE * len(v))::BIGINT + 1 : len(v) - floor(0.1::DOUBLE * len(v))::BIGINT], 'avg')")
_val("sd", vectors.sd, NUM("stddev_pop"))
_val("max", vectors.max_, NUM("max"))
_val("min", vectors.min_, NUM("min"))
_val("sum", vectors.sum_, NUM("sum"))
_val("n", vectors.n, "len(v)::BIGINT", False)
_val("med", vectors.med, NUM("median"))
_vec("q", vectors.q, "SELECT_ row_id, k AS j, round(quantile_cont(x, 0.25 * k), 6) AS x FROM (SELECT row_id, x, 0 AS k FROM cell) GROUP BY ALL")
S["vec_q"] = X.CTES + "_u AS (SELECT 1) " + " UNION ALL ".join(f"SELECT row_id, {k}::BIGINT AS j, round(quantile_cont(x, {k / 4}), 6) AS x FROM cell GROUP BY row_id" for k in range(5))
_vec("merge", vectors.merge, "SELECT_ (row_id // 3) * 3 AS row_id, row_number() OVER (PARTITION BY row_id // 3 ORDER BY row_id, j) - 1 AS j, round(x, 6) AS x FROM cell")
_vec("norm", vectors.norm, "SELECT_ row_id, j, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS x FROM cell WINDOW w AS (PARTITION BY row_id)")
_vec("norm_range", lambda v: vectors.norm(v, "range"), "SELECT_ row_id, j, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) AS x FROM cell WINDOW w AS (PARTITION BY row_id)")
_add("vec_pairs", lambda s, d: vectors.pairs(X.vec(s, d).where("row_id < 200"), 64).selectExpr("i.row_id AS i", "j.row_id AS j"), "SELECT_ a.row_id AS i, b.row_id AS j FROM vec a JOIN vec b ON a.row_id < b.row_id AND b.row_id < 200")
Q["vec_pairs"] = lambda s, d: vectors.pairs(X.vec(s, d), 64).groupBy(F.col("i.row_id").alias("i")).agg(F.count("*").alias("partners"), F.sum("j.row_id").alias("partner_sum"))
S["vec_pairs"] = X.CTES + "_u AS (SELECT 1) SELECT a.row_id AS i, count(*) AS partners, sum(b.row_id)::BIGINT AS partner_sum FROM vec a JOIN vec b ON a.row_id < b.row_id GROUP BY 1"
_add("vec_permute", lambda s, d: _cells(vectors.permute(X.vec(s, d), 5)), "SELECT_ row_id, j, round(x, 6) AS x FROM cell")
_add("vec_shuffle", lambda s, d: _cells(vectors.shuffle(X.vec(s, d), 5)))
_vec("rank", vectors.rank, "SELECT_ row_id, j, (row_number() OVER (PARTITION BY row_id ORDER BY x, j))::DOUBLE AS x FROM cell")
_vec("rank_norm", lambda v: vectors.rank(v, True), "SELECT_ row_id, j, round((row_number() OVER (PARTITION BY row_id ORDER BY x, j)) / (count(*) OVER (PARTITION BY row_id))::DOUBLE, 6) AS x FROM cell")
_vec("rev", vectors.rev, "SELECT_ row_id, len(v) - 1 - j AS j, round(x, 6) AS x FROM cell JOIN vec USING (row_id)")
_vec("sort", vectors.sort, "SELECT_ row_id, row_number() OVER (PARTITION BY row_id ORDER BY x) - 1 AS j, round(x, 6) AS x FROM cell")
_add("vec_slide", lambda s, d: _cells(vectors.slide(X.vec(s, d), 2, 10).withColumn("row_id", F.expr("row_id * 100 + part"))), "SELECT_ row_id * 100 + p AS row_id, j - p * 10 AS j, round(x, 6) AS x FROM cell JOIN vec USING (row_id), range(10) t(p) WHERE j BETWEEN p * 10 AND p * 10 + 4 AND p * 10 + 5 <= len(v)")
_add("vec_sparse", lambda s, d: vectors.sparse(X.vec(s, d)).selectExpr("row_id", "nullif(text, '') AS text"), "SELECT_ row_id, string_agg(j || ':' || printf('%.6f', x), ' ' ORDER BY j) FILTER (x <> 0) AS text FROM cell GROUP BY row_id")
_STAT = "count(*) AS n, round(sum(x), 6) AS sum, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd"
_R6 = [f"round({c}, 6) AS {c}" for c in ("sum", "min", "max", "mean", "sd")]
_add("vec_stat", lambda s, d: vectors.stat(X.vec(s, d)).selectExpr("row_id", "n", *_R6, "round(median, 6) AS median"), f"SELECT_ row_id, {_STAT}, round(median(x), 6) AS median FROM cell GROUP BY row_id")
_vec("test", lambda v: vectors.test(v, 0.05), "SELECT_ row_id, j, CASE WHEN x >= 0.05 THEN 1 ELSE 0 END::DOUBLE AS x FROM cell")


def _mat(name, op, sql):
    _add(f"mat_{name}", lambda s, d: _cells(op(X.vec(s, d))), sql)


_mat("T", matrix.transpose, "SELECT_ j AS row_id, row_number() OVER (PARTITION BY j ORDER BY row_id) - 1 AS j, round(x, 6) AS x FROM cell")
_mat("norm", lambda v: matrix.norm(v, 0.5, 2.0), "SELECT_ row_id, j, round((x - 0.5) / 2, 6) AS x FROM cell")
_mat("rnorm", matrix.rnorm, S["vec_norm"][len(X.CTES) :].replace("_u AS (SELECT 1)\nSELECT ", "SELECT_ "))
_mat("cnorm", matrix.cnorm, "SELECT_ row_id, j, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS x FROM cell WINDOW w AS (PARTITION BY j)")
_add("mat_cstat", lambda s, d: matrix.cstat(X.vec(s, d)).selectExpr("cast(col_id as bigint) AS col_id", *_R6), f"SELECT_ j AS col_id, {_STAT.replace('count(*) AS n, ', '')} FROM cell GROUP BY j")
_add("mat_csum", lambda s, d: matrix.csum(X.vec(s, d)).selectExpr("cast(col_id as bigint) AS col_id", "round(sum, 6) AS sum"), "SELECT_ j AS col_id, round(sum(x), 6) AS sum FROM cell GROUP BY j")
_add("mat_rstat", lambda s, d: matrix.rstat(X.vec(s, d)).selectExpr("row_id", *_R6, "round(cv, 3) AS cv", "count"), f"SELECT_ row_id, {_STAT.replace('count(*) AS n, ', '')}, round(stddev_pop(x) / avg(x), 3) AS cv, count(*) AS count FROM cell GROUP BY row_id")
_mat("cutoff", lambda v: matrix.cutoff(v, 0.0, 0.0), "SELECT_ row_id, j, round(greatest(x, 0), 6) AS x FROM cell")
_mat("test", lambda v: matrix.test(v, 0.1, ">"), "SELECT_ row_id, j, CASE WHEN x > 0.1 THEN 1 ELSE 0 END::DOUBLE AS x FROM cell")
_mat("mult", lambda v: matrix.mult(v, 3.5), "SELECT_ row_id, j, round(x * 3.5::DOUBLE, 6) AS x FROM cell")
Q["mat_pairs"], S["mat_pairs"] = Q["vec_pairs"], S["vec_pairs"]
Q["mat_sparse"], S["mat_sparse"] = Q["vec_sparse"], S["vec_sparse"]
_mat("encode", lambda v: matrix.encode(v, 16), "SELECT_ row_id, j, round(j * 16.0::DOUBLE + x, 6) AS x FROM cell")
Q["mat_shuffle"] = Q["vec_shuffle"]
Q["mat_format"], S["mat_format"] = Q["vec_format"], S["vec_format"]
_mat("shrink", lambda v: matrix.shrink(v.withColumn("v", F.transform("v", lambda x, j: F.when(j % 3 == 0, 0.0).otherwise(x)))), "SELECT_ row_id, j - 1 - j // 3 AS j, round(x, 6) AS x FROM cell WHERE j % 3 <> 0")
_mat("rel", matrix.rel, "SELECT_ row_id, j - 1 AS j, round(x / px, 6) AS x FROM (SELECT *, lag(x) OVER (PARTITION BY row_id ORDER BY j) AS px FROM cell) WHERE px IS NOT NULL")
_mat("rel_first", lambda v: matrix.rel(v, "first"), S["vec_div"][len(X.CTES) :].replace("_u AS (SELECT 1)\nSELECT ", "SELECT_ "))
_add("mat_rel_all", lambda s, d: _cells(matrix.rel(X.vec(s, d), "all")), "SELECT_ a.row_id, row_number() OVER (PARTITION BY a.row_id ORDER BY a.j, b.j) - 1 AS j, round(b.x / a.x, 6) AS x FROM cell a JOIN cell b ON a.row_id = b.row_id AND a.j < b.j")
_add("mat_del", lambda s, d: matrix.drop_correlated(matrix.transpose(X.vec(s, d)).withColumn("label", F.lit("c")), 0.3).select("row_id"))

_YS = {
    "sum": "v / d", "n": "k::DOUBLE", "sens": "k / n", "spec": "k / k_all", "ratio": "(v / d) / ((v_all - v) / (d_all - d))", "corr": "r",
    "t": "(v / d - (v_all - v) / (d_all - d)) / sqrt((zz / n - pow(z / n, 2)) / n + ((zz_all - zz) / (n_all - n) - pow((z_all - z) / (n_all - n), 2)) / (n_all - n))",
}
for _h, _y in _YS.items():
    _add(f"enr_{_h}", lambda s, d, h=_h: enrichment.statistic(X.cats(s, d), h).selectExpr("category", "size", "round(y, 6) AS y"), f"SELECT_ category, n AS size, round({_y}, 6) AS y FROM cat, allp")
_add("enr_sum_under", lambda s, d: enrichment.statistic(X.cats(s, d), "sum", under=True).selectExpr("category", "size", "round(y, 6) AS y"), "SELECT_ category, n AS size, round(-v / d, 6) AS y FROM cat, allp")
_add("enr_n_hyper", lambda s, d: enrichment.statistic(X.cats(s, d), "n", approx=True).selectExpr("category", "size", "round(y, 9) AS y"),
     "SELECT_ category, n AS size, round(least(1, list_sum(list_transform(range(greatest(k, n - (n_all - k_all))::BIGINT, least(k_all, n)::BIGINT + 1), lambda j: exp(lgamma(k_all + 1) - lgamma(j + 1) - lgamma(k_all - j + 1) + lgamma(n_all - k_all + 1) - lgamma(n - j + 1) - lgamma(n_all - k_all - n + j + 1) - lgamma(n_all + 1) + lgamma(n + 1) + lgamma(n_all - n + 1))))), 9) AS y FROM cat, allp")
_add("enr_t_tail", lambda s, d: enrichment.statistic(X.cats(s, d), "t", approx=True))
_add("enr_empirical", lambda s, d: enrichment.empirical(X.cats(s, d), "sum", permutations=50, seed=1))
_add("enr_bh", lambda s, d: enrichment.adjusted(enrichment.statistic(X.cats(s, d), "sens").selectExpr("category", "1 - y AS p")).selectExpr("category", "round(p, 6) AS p", "round(fdr, 6) AS fdr", "round(q, 6) AS q"),
     "t AS (SELECT category, 1 - k / n AS p FROM cat), o AS (SELECT *, row_number() OVER (ORDER BY p, category) AS nr, count(*) OVER () AS n FROM t), f AS (SELECT *, min(least(p * n / nr, 1)) OVER (ORDER BY nr DESC) AS fdr FROM o), s AS (SELECT *, CASE WHEN nr = 1 THEN 0 ELSE nr * fdr - (nr - 1) * lag(fdr) OVER (ORDER BY nr) END AS step FROM f) SELECT_ category, round(p, 6) AS p, round(fdr, 6) AS fdr, round(least(max(step) OVER (ORDER BY nr), 1), 6) AS q FROM s")


_SHIFTED = "transform(iv, x -> named_struct('chrom', x.chrom, 'strand', x.strand, 'start', x.start + 50, 'stop', x.stop + 50))"
_with_other = lambda s, d: X.spliced(s, d, apart=True).withColumn("other", F.expr(_SHIFTED))
_reg("meet", regions.meet, "SELECT_ a.region_id, row_number() OVER (PARTITION BY a.region_id ORDER BY greatest(a.start, b.start + 50)) - 1 AS k, a.chrom, a.strand, greatest(a.start, b.start + 50) AS start, least(a.stop, b.stop + 50) AS stop FROM apart a JOIN apart b ON a.region_id = b.region_id AND a.start <= b.stop + 50 AND b.start + 50 <= a.stop", _with_other)
_reg("clip", regions.clip, "e AS (SELECT region_id, min(start) + 50 AS lo, max(stop) + 50 AS hi FROM apart GROUP BY 1) SELECT_ region_id, row_number() OVER (PARTITION BY region_id ORDER BY k) - 1 AS k, chrom, strand, greatest(start, lo) AS start, least(stop, hi) AS stop FROM apart JOIN e USING (region_id) WHERE greatest(start, lo) <= least(stop, hi)", _with_other)
_reg("between", regions.between, "SELECT_ region_id, 0::BIGINT AS k, chrom, strand, stop + 51 AS start, start - 1 AS stop FROM apart WHERE k = 0", _with_other)
_add("ovl_per_test_coverage", lambda s, d: overlaps.per_test_coverage(X.tests(s, d), X.refs(s, d)), f"SELECT_ t.region_id, sum(least(t.stop, r.stop) - greatest(t.start, r.start) + 1)::BIGINT AS coverage FROM tests t JOIN refs r ON {MEET} GROUP BY 1")

_REL = ("inner", "covariance", "euclid", "pearson", "relative_entropy", "chi2")


def _relations(s, d):
    """Every vector, all its values made positive, against the next one."""
    v = X.vec(s, d).selectExpr("row_id", "transform(v, x -> abs(x) + 0.01D) AS a")
    both = v.join(v.selectExpr("row_id - 1 AS row_id", "a AS b"), "row_id")
    return both.selectExpr("row_id", *(f"round({vec_sql.relation(k)}, 5) AS {k}" for k in _REL))


_add("vec_relations", _relations, "p AS (SELECT row_id, j, abs(x) + 0.01::DOUBLE AS x FROM cell), b AS (SELECT p.row_id, p.x, q.x AS y FROM p JOIN p q ON q.row_id = p.row_id + 1 AND q.j = p.j), t AS (SELECT row_id, sum(x) AS n, sum(y) AS m FROM b GROUP BY 1) SELECT_ row_id, round(sum(x * y), 5) AS inner, round(avg(x * y), 5) AS covariance, round(sqrt(sum((x - y) * (x - y))), 5) AS euclid, round(corr(x, y), 5) AS pearson, round(sum(x / n * log2(x / n / (y / m))), 5) AS relative_entropy, round(sqrt(sum((x - y) * (x - y) / y)), 5) AS chi2 FROM b JOIN t USING (row_id) GROUP BY row_id".replace(" AS inner,", ' AS "inner",'))
_add("enr_permuted_fdr", lambda s, d: enrichment.permuted_fdr(X.cats(s, d), "n", permutations=20, seed=1))


def _through(s, lines, read):
    """``lines`` written as text to the shared folder, and read again."""
    path = f"{matrix.shared_folder(s)}/lines-{uuid.uuid4().hex}"
    formats.write_lines(lines, path)
    return read(s, path)


def _by_label(df):
    return df.select("label", F.posexplode("iv").alias("k", "x")).selectExpr("label", "cast(k as bigint) AS k", "x.chrom", "x.strand", "x.start", "x.stop")


_APART = "SELECT_ 'r' || region_id AS label, k, chrom, strand, start, stop FROM apart"
_add("src_reg", lambda s, d: _by_label(_through(s, formats.as_reg(X.spliced(s, d, apart=True)), formats.read_regions)), _APART)
_add("src_bed", lambda s, d: _by_label(_through(s, formats.as_bed(X.spliced(s, d, apart=True)), formats.read_regions)), _APART)
_add("src_gff", lambda s, d: _by_label(_through(s, formats.as_gff(X.refs(s, d)), formats.read_regions)), "SELECT_ label, 0::BIGINT AS k, chrom, strand, start, stop FROM refs")
_add("src_categories", lambda s, d: _through(s, X.cats(s, d).selectExpr("concat_ws('\\t', label, concat(value, ' ', total), array_join(transform(categories, c -> replace(c, ' ', '_')), ' ')) AS value"), formats.read_categories).selectExpr("label", "round(value, 4) AS value", "total", "array_join(categories, ' ') AS keys"),
     "SELECT_ p_partkey::VARCHAR AS label, round(p_retailprice - 950, 4) AS value, (p_size + 1)::DOUBLE AS total, replace(p_brand, ' ', '_') || ' ' || replace(p_type, ' ', '_') AS keys FROM part")
_add("src_matrix", lambda s, d: _by_cell(_through(s, X.vec(s, d).selectExpr("concat(label, '-', row_id, '\\t', array_join(transform(v, x -> cast(x as string)), ' ')) AS value"), formats.read_matrix)[0]), "SELECT_ label || '-' || row_id AS label, j, round(x, 6) AS x FROM cell")
_add("src_vectors", lambda s, d: _by_cell(_through(s, X.vec(s, d).selectExpr("concat(label, '-', row_id, '\\t', array_join(transform(v, x -> cast(x as string)), ' ')) AS value"), formats.read_vectors)), "SELECT_ label || '-' || row_id AS label, j, round(x, 6) AS x FROM cell")


def _by_cell(df):
    return df.select("label", F.posexplode("v").alias("j", "x")).selectExpr("label", "cast(j as bigint) AS j", "round(x, 6) AS x")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(S)
