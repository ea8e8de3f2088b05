"""Readers, writers and streams."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandmill.operators import regions
from strandmill.sources import formats
from strandmill.streaming import regions as streams


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_bed_and_reg(spark, tmp_path):
    bed = put(tmp_path, "a.bed", "track name=x\nchr1\t9\t20\tg\t5\t-\nchr1\t0\t100\tb\t0\t+\t0\t100\t0,0,0\t2\t10,20\t0,80")
    df = formats.read_regions(spark, bed).orderBy("region_id")
    rows = df.collect()
    assert [(x.start, x.stop, x.strand) for x in rows[0].iv] == [(10, 20, "-")] and [(x.start, x.stop) for x in rows[1].iv] == [(1, 10), (81, 100)]
    reg = put(tmp_path, "a.reg", "\n".join(r.value for r in formats.as_reg(df).orderBy("region_id").collect()))
    again = formats.read_regions(spark, reg).orderBy("region_id").collect()
    assert [r.iv for r in again] == [r.iv for r in rows]
    assert formats.as_bed(df).orderBy("region_id").first().value == "chr1\t9\t20\tg\t1000\t-"


def test_sam(spark, tmp_path):
    sam = put(tmp_path, "a.sam", "@HD\tVN:1\nr\t16\tchr1\t5\t60\t3M4N2=1I\t*\t0\t0\tACGTAC\tIIIIII\tXS:i:1\n")
    r = formats.read_regions(spark, sam).first()
    assert [(x.start, x.stop, x.strand) for x in r.iv] == [(5, 7, "-"), (12, 13, "-")] and r.sam.optional == "XS:i:1"
    with pytest.raises(Exception, match="lengths"):
        formats.read_regions(spark, put(tmp_path, "b.sam", "r\t0\tchr1\t5\t60\t3M\t*\t0\t0\tACGT\tIIII\n"), "SAM").collect()


def test_sequences(spark, tmp_path):
    fa = formats.read_fasta(spark, put(tmp_path, "g.fa", ">chr1\nACGTNACGTT\n"), chunk=4)
    reg = formats.read_regions(spark, put(tmp_path, "s.reg", "a\tchr1 + 2 6\nb\tchr1 - 2 3 chr1 - 9 10\n"))
    got = [r.seq for r in regions.extract(reg, fa).orderBy("region_id").collect()]
    assert got == ["CGTNA", "AACG"]
    hits = regions.search(regions.extract(reg.where("label = 'a'"), fa), "GTN").first()
    assert (hits.iv[0].start, hits.iv[0].stop) == (2 + 0, 4) or (hits.iv[0].start, hits.iv[0].stop) == (3, 5)
    gff = formats.read_regions(spark, put(tmp_path, "a.gff", "chr1\ts\tf\t3\t9\t.\t.\t.\tname\n"), "GFF").first()
    assert gff.iv[0].strand == "." and gff.iv[0].start == 3


def test_vectors(spark, tmp_path):
    v = formats.read_vectors(spark, put(tmp_path, "v.txt", "a\t1 2.5 nan\n0:1 2:7\n")).orderBy("row_id").collect()
    assert v[0].label == "a" and v[0].v[:2] == [1.0, 2.5] and v[1].v == [1.0, 0.0, 7.0]


def test_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.range(10).selectExpr("id AS region_id", "'x' AS label", "array(named_struct('chrom', 'chr1', 'strand', '+', 'start', id * 10, 'stop', id * 10 + 3)) AS iv")
    df.write.parquet(path)
    stream = streams.read_stream(spark, path, df.schema)
    moved = streams.transform(stream, lambda d: regions.shift(d, 1, 1))
    met = streams.ref_counts(moved, df, bits=4)
    q = met.writeStream.outputMode("complete").format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hits").agg(F.sum("hits")).first()[0] == 10


def bgzf(data, step=500):
    """Blocks of ``step`` bytes, whatever records they cut, and the empty one at the end."""
    out = b""
    for k in [*range(0, len(data), step), None]:
        part = b"" if k is None else data[k : k + step]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam(n):
    """A file of n records and their lines of SAM."""
    refs = [(b"chr1\0", 1_000_000), (b"chr2\0", 900_000)]
    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(r)) + r + struct.pack("<i", k) for r, k in refs)
    lines = []
    for i in range(n):
        name, ops, seq, unmapped = f"read{i}", [(3, 0), (i % 5 + 1, 3), (2, 0)], "ACGTN", i % 7 == 0
        ops = [] if unmapped else ops
        ref, pos = (-1, -1) if unmapped else (i % 2, i * 10)
        tags = b"NMC" + bytes([i % 200]) + b"XSZplus\0" + b"XBBs" + struct.pack("<ihh", 2, -1, i)
        half = bytes(("=ACMGRSVTWYHKDBN".index(a) << 4) | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip(seq[::2], seq[1::2] + "=", strict=True))
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), 16 if i % 3 else 0, 5, ref, pos, 7) + name.encode() + b"\0"
        body += struct.pack(f"<{len(ops)}I", *((k << 4) | o for k, o in ops)) + half + bytes([40] * 5) + tags
        data += struct.pack("<i", len(body)) + body
        chrom = "*" if unmapped else f"chr{i % 2 + 1}"
        lines.append("\t".join([name, str(16 if i % 3 else 0), chrom, str(pos + 1), "60", "".join(f"{k}{'MIDN'[o]}" for k, o in ops) or "*", "*" if unmapped else "=", str(pos + 1), "7", seq, "IIIII", f"NM:i:{i % 200}", "XS:Z:plus", f"XB:B:s,-1,{i}"]))
    return bgzf(data), lines


def test_bam(spark, tmp_path):
    data, lines = bam(400)
    path = put(tmp_path, "none.txt", "").replace("none.txt", "a.bam")
    (tmp_path / "a.bam").write_bytes(data)
    for split in (None, 1 << 20, 5000, 1500, 700, 100):
        df = formats.read_bam(spark, path, split)
        assert sorted(r.value for r in df.collect()) == sorted(lines), split
    assert formats.read_bam(spark, path, 1500).rdd.getNumPartitions() > 4
    regions_ = {r.label: r for r in formats.read_regions(spark, path).collect()}
    assert len(regions_) == 400 and [(x.chrom, x.start, x.stop) for x in regions_["read1"].iv] == [("chr2", 11, 13), ("chr2", 16, 17)]
    (tmp_path / "b.bam").write_bytes(bam(0)[0])
    assert formats.read_bam(spark, str(tmp_path / "b.bam"), 50).count() == 0


def test_categories(spark, tmp_path):
    one = formats.read_categories(spark, put(tmp_path, "c.txt", "a\t1.5 3\tx y  x\nb\t2 4\t\n")).orderBy("label").collect()
    assert [(r.label, r.value, r.total, r.categories) for r in one] == [("a", 1.5, 3.0, ["x", "y", "x"]), ("b", 2.0, 4.0, [])]
    two = formats.read_categories(spark, put(tmp_path, "k.txt", "a\tx y\nb\tz\n"), put(tmp_path, "v.txt", "5\n7\n")).orderBy("label").collect()
    assert [(r.label, r.value, r.total, r.categories) for r in two] == [("a", 5.0, 1.0, ["x", "y"]), ("b", 7.0, 1.0, ["z"])]
    for text in ("a\t1 2 3\tx\n", "a\t\tx\n", "a\tq\tx\n"):
        with pytest.raises(Exception, match="one or two numbers"):
            formats.read_categories(spark, put(tmp_path, "bad.txt", text)).collect()
    with pytest.raises(Exception, match="one or two numbers"):
        formats.read_categories(spark, put(tmp_path, "k.txt", "a\tx\nb\ty\n"), put(tmp_path, "v.txt", "5\n")).collect()


def test_matrix_files(spark, tmp_path):
    df, names = formats.read_matrix(spark, put(tmp_path, "m.txt", "\tp q\na\t1 2\nb\t3 nan\n"))
    rows = df.orderBy("row_id").collect()
    assert names == ["p", "q"] and [r.label for r in rows] == ["a", "b"] and rows[0].v == [1.0, 2.0] and rows[1].v[1] != rows[1].v[1]
    df, names = formats.read_matrix(spark, put(tmp_path, "n.txt", "1 2\n3 4\n"))
    assert names is None and [(r.label, r.v) for r in df.orderBy("row_id").collect()] == [(None, [1.0, 2.0]), (None, [3.0, 4.0])]
    with pytest.raises(Exception, match="a row of 2 values"):
        formats.read_matrix(spark, put(tmp_path, "o.txt", "1 2\n3 4 5\n"))[0].collect()


def test_chromosome_map(spark, tmp_path):
    put(tmp_path, "one.fa", ">chr1 x\nACGT\nAC\n"), put(tmp_path, "two.raw", "TTTT\n")
    put(tmp_path, "map.txt", "chr1 one.fa\nchr2\ttwo.raw\n")
    got = formats.read_chromosome_map(spark, str(tmp_path), "map.txt", chunk=4).orderBy("chrom", "chunk_no").collect()
    assert [(r.chrom, r.chunk_no, r.seq) for r in got] == [("chr1", 0, "ACGT"), ("chr1", 1, "AC"), ("chr2", 0, "TTTT")]


def test_bed_as_read(spark, tmp_path):
    lines = ["chr1\t9\t20\tg\t5\t-", "chr1\t0\t100\tb\t7\t+\t1\t99\t1,2,3\t2\t10,20\t0,80", "chr2\t4\t9"]
    df = formats.read_regions(spark, put(tmp_path, "r.bed", "\n".join(lines)))
    assert [r.value for r in formats.as_read(df).orderBy("region_id").collect()] == lines
    assert formats.as_read(regions.shift(df, 1, 1)).orderBy("region_id").first().value == "chr1\t10\t21\tg\t5\t-"
    assert formats.track_lines("bed", "t", position="chr1:1-9") == ["browser position chr1:1-9", "track name='t' itemRgb=On visibility=1"] and formats.track_lines("wig") == []
