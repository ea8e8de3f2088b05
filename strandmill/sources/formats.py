"""Readers and writers of region formats, as DataFrames of lines.

Coordinates of BED count from 0 on disk; inside all count from 1.  Rows are numbered as Spark deals files to
partitions: in order within a file.  A last line without a line feed is read; the CIGAR
operation '=' is accepted.  Malformed lines raise, unless ``strict`` is off, which drops them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.regions import INTERVAL
from strandmill.sources.bam import BamSource

SCHEMA = f"label string, iv array<{INTERVAL}>, seq string, bed struct<n_tokens:int,score:bigint,thick_start:bigint,thick_end:bigint,rgb:string>, sam struct<flag:int,mapq:int,cigar:array<struct<len:bigint,op:string>>,rnext:string,pnext:bigint,tlen:bigint,qual:string,optional:string>, gff struct<source:string,feature:string,score:string,frame:string,comment:string>"
STRAND = {"1": "+", "+": "+", ".": "+", "-1": "-", "-": "-"}


def strand_of(token: str) -> str:
    if token not in STRAND:
        raise ValueError(f"no strand: {token!r}")
    return STRAND[token]


def sniff(line: str) -> str:
    """The format of a first data line."""
    t = line.split("\t")
    if line.startswith(">"):
        return "SEQ"
    if len(t) == 1:
        return "BED"
    if len(t) == 2:
        return "REG"
    if len(t) <= 6 or any(c in t[5] for c in "+-"):
        return "BED"
    if len(t) >= 11:
        return "SAM"
    if len(t) >= 8:
        return "GFF"
    raise ValueError("unsupported format")


def is_header(line: str) -> bool:
    return not line.strip() or line.startswith(("browser ", "track ", "@", "##"))


def _iv(chrom: str, strand: str, start: int, stop: int) -> dict:
    return {"chrom": chrom, "strand": strand, "start": start, "stop": stop}


def parse_reg(line: str) -> dict:
    label, rest = line.split("\t")[:2]
    t = rest.split()
    if len(t) == 4 and ("," in t[2] or "," in t[3]):
        starts, stops = ([int(x) for x in y.split(",") if x] for y in t[2:])
        return {"label": label, "iv": [_iv(t[0], strand_of(t[1]), a, b) for a, b in zip(starts, stops, strict=True)]}
    if len(t) % 4 or not t:
        raise ValueError("intervals have four fields each")
    return {"label": label, "iv": [_iv(t[i], strand_of(t[i + 1]), int(t[i + 2]), int(t[i + 3])) for i in range(0, len(t), 4)]}


def parse_bed(line: str) -> dict:
    t = line.split("\t") if "\t" in line else line.split()
    strand, start, end = strand_of(t[5]) if len(t) > 5 else "+", int(t[1]), int(t[2])
    iv = [_iv(t[0], strand, start + 1, end)]
    if len(t) == 12:
        sizes, offsets = ([int(x) for x in t[k].split(",") if x] for k in (10, 11))
        iv = [_iv(t[0], strand, start + o + 1, start + o + s) for s, o in zip(sizes, offsets, strict=True)]
    num = lambda k: int(float(t[k])) if len(t) > k else None
    return {"label": t[3] if len(t) > 3 else "_", "iv": iv, "bed": {"n_tokens": len(t), "score": num(4), "thick_start": num(6), "thick_end": num(7), "rgb": t[8] if len(t) > 8 else None}}


def parse_cigar(text: str) -> list[tuple[int, str]]:
    out, n = [], ""
    for c in "" if text == "*" else text:
        if c.isdigit():
            n += c
        elif c in "MIDNSHPX=" and n:
            out.append((int(n), c))
            n = ""
        else:
            raise ValueError(f"bad CIGAR: {text}")
    return out


def cigar_lengths(cigar: list[tuple[int, str]]) -> tuple[int, int]:
    """Bases of the reference and of the read."""
    return sum(n for n, c in cigar if c in "MDN=X"), sum(n for n, c in cigar if c in "MIS=X")


def parse_sam(line: str) -> dict:
    t = line.split("\t", 11)
    flag, start, cigar = int(t[1]), int(t[3]), parse_cigar(t[5])
    if t[9] != "*" and cigar and cigar_lengths(cigar)[1] != len(t[9]):
        raise ValueError("sequence and CIGAR have different lengths")
    strand, iv, at = "-" if flag & 16 else "+", [], start
    stop = at - 1
    for n, c in cigar:
        if c == "N":
            iv.append(_iv(t[2], strand, at, stop))
            stop += n
            at = stop + 1
        elif c in "MD=X":
            stop += n
    iv.append(_iv(t[2], strand, at, max(stop, at) if not cigar else stop))
    sam = {"flag": flag, "mapq": int(t[4]), "cigar": [{"len": n, "op": c} for n, c in cigar], "rnext": t[6], "pnext": int(t[7]), "tlen": int(t[8]), "qual": t[10], "optional": t[11] if len(t) > 11 else ""}
    return {"label": t[0], "iv": iv, "seq": t[9], "sam": sam}


def parse_gff(line: str) -> dict:
    t = line.split("\t")
    return {"label": t[8] if len(t) > 8 else "_", "iv": [_iv(t[0], t[6][:1], int(t[3]), int(t[4]))], "gff": {"source": t[1], "feature": t[2], "score": t[5], "frame": t[7], "comment": t[9] if len(t) > 9 else None}}


PARSERS = {"REG": parse_reg, "BED": parse_bed, "SAM": parse_sam, "GFF": parse_gff}


def read_regions(spark: SparkSession, path: str, fmt: str | None = None, *, strict: bool = True) -> DataFrame:
    """region_id, label, iv and what the format has besides; ``path``: text, also gzipped.

    The format is sniffed from the first data line, unless named; BAM is told by its name's end.  SEQ records are
    two lines and read whole by file.
    """
    if fmt == "BAM" or fmt is None and path.endswith(".bam"):
        lines, fmt = read_bam(spark, path), "SAM"
    else:
        lines = spark.read.text(path)
    if fmt is None:
        first = lines.where("trim(value) <> '' AND NOT (value LIKE 'browser %' OR value LIKE 'track %' OR value LIKE '@%' OR value LIKE '##%')").first()
        fmt = sniff(first["value"]) if first else "REG"
    if fmt == "SEQ":
        text = spark.read.text(path, wholetext=True)
        pairs = text.select(F.explode(F.expr("regexp_extract_all(value, '>[^\\\\n]*\\\\n[^\\\\n>]*', 0)")).alias("value"))
        lines = pairs.selectExpr("translate(substring(value, 2), '\\r', '') AS value")
    fields = ["label", "iv", "seq", "bed", "sam", "gff"]
    out_schema = spark.createDataFrame([], SCHEMA).schema

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        for b in batches:
            got: list[dict] = []
            for line in b.column(0).to_pylist():
                head, _, seq = line.partition("\n") if fmt == "SEQ" else (line, "", None)
                if is_header(head):
                    continue
                try:
                    row = (parse_reg if fmt == "SEQ" else PARSERS[fmt])(head)
                except (ValueError, IndexError):
                    if strict:
                        raise
                    continue
                got.append({**dict.fromkeys(fields), **row, **({"seq": seq} if fmt == "SEQ" else {})})
            yield pa.RecordBatch.from_pylist(got, schema=arrow)

    parsed = lines.select("value").mapInArrow(parse, out_schema)
    return parsed.select(F.monotonically_increasing_id().alias("region_id"), *fields)


def read_bam(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """value: the records of a BAM file, or of all of a folder, as lines of SAM."""
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam")
    return (reader.option("split", split) if split else reader).load(path)


def read_categories(spark: SparkSession, path: str, values: str | None = None) -> DataFrame:
    """label, value, total, categories: label, a tab, one or two numbers, a tab, and keys by spaces.

    With ``values``, the numbers stand in that file instead, a line for each line of ``path``.  The total is 1 where
    there is one number; lines with none or with more than two raise.
    """
    number = "split(trim({0}), '[ \\\\t]+')".format
    if values is None:
        body = spark.read.text(path).where("trim(value) <> ''").selectExpr("split(value, '\\t') AS t")
        body = body.selectExpr("t[0] AS label", f"{number('t[1]')} AS x", "coalesce(try_element_at(t, 3), '') AS keys")
    else:
        left, right = _numbered(spark, path), _numbered(spark, values)
        # A missing partner raises below, as its numbers are null.
        body = left.join(right.withColumnRenamed("value", "numbers"), "nr", "full").selectExpr("substring_index(value, '\\t', 1) AS label", f"{number('numbers')} AS x", "CASE WHEN instr(value, '\\t') > 0 THEN substring(value, instr(value, '\\t') + 1) ELSE '' END AS keys")
    right_size = "label IS NOT NULL AND size(x) BETWEEN 1 AND 2 AND forall(x, y -> try_cast(y AS double) IS NOT NULL)"
    checked = f"CASE WHEN coalesce({right_size}, false) THEN cast(x[0] AS double) ELSE raise_error(concat('one or two numbers are needed: ', coalesce(label, ''))) END AS value"
    return body.selectExpr("label", checked, "coalesce(cast(try_element_at(x, 2) AS double), 1D) AS total", "filter(split(keys, ' +'), k -> k <> '') AS categories")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """value and nr, the line's place in a file, from 0: lines are counted by partition, then in each."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id")).withColumn("part", F.shiftright("id", 33))
    before = (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before")
    parts = lines.groupBy("part").count().select("part", before)  # a row for each partition
    return lines.join(F.broadcast(parts), "part").select((F.col("id").bitwiseAND((1 << 33) - 1) + F.col("before")).alias("nr"), "value")


def read_matrix(spark: SparkSession, path: str, *, row_labels: bool | None = None, column_labels: bool | None = None, separator: str = " ") -> tuple[DataFrame, list[str] | None]:
    """(row_id, label, v) and the labels of the columns.

    A first line that starts with a tab has column labels, and a tab in the first line means row labels, unless told;
    rows of another length, or with and without labels, raise.
    """
    lines = spark.read.text(path).where("value <> ''")
    first = lines.first()
    first = first["value"] if first else ""
    heads = first.startswith("\t") if column_labels is None else column_labels
    named = (separator == " " and "\t" in first) if row_labels is None else row_labels
    cells = lambda t: [x for x in t.split(separator) if x != ""]
    width = cells(first.split("\t", 1)[1] if named and "\t" in first else first)
    if heads:
        lines = lines.where(F.col("value") != first)
    body = "substring(value, instr(value, '\t') + 1)" if named else "value"
    out = lines.selectExpr("CASE WHEN instr(value, '\t') > 0 THEN substring_index(value, '\t', 1) END AS label", f"filter(split({body}, '{re.escape(separator)}'), x -> x <> '') AS t") if separator == " " or named else lines.selectExpr("cast(NULL AS string) AS label", f"filter(split(value, '{re.escape(separator)}'), x -> x <> '') AS t")
    fits = f"size(t) = {len(width)}" + (f" AND label IS {'NOT ' if named else ''}NULL" if separator == " " else "")
    value = f"CASE WHEN {fits} THEN transform(t, x -> cast(x AS double)) ELSE raise_error(concat('a row of {len(width)} values is needed: ', array_join(t, ' '))) END AS v"
    return out.selectExpr("monotonically_increasing_id() AS row_id", "label", value), width if heads else None


def read_chromosome_map(spark: SparkSession, folder: str, name: str, chunk: int = 65_536) -> DataFrame:
    """chrom, chunk_no, seq, as ``read_fasta``: ``name`` lists chromosomes and their files in ``folder``, one sequence each, with or without a first line ``>...``."""
    listed = spark.read.text(f"{folder}/{name}").where("trim(value) <> ''").selectExpr("split(trim(value), '[ \\t]+') AS t").selectExpr("t[0] AS chrom", "t[1] AS file")
    files = sorted({r["file"] for r in listed.select("file").distinct().collect()})  # a file for each chromosome
    text = spark.read.text([f"{folder}/{f}" for f in files], wholetext=True).selectExpr("value", "element_at(split(input_file_name(), '/'), -1) AS base")
    seq = text.selectExpr("base", "regexp_replace(regexp_replace(value, '^>[^\\n]*\\n', ''), '\\\\s+', '') AS seq")
    seq = listed.selectExpr("chrom", "element_at(split(file, '/'), -1) AS base").join(seq, "base")
    return _chunks(seq, chunk)


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length; different lengths of one chromosome raise."""
    one = read_regions(spark, path).selectExpr("iv[0].chrom AS chrom", "iv[0].stop AS length").groupBy("chrom").agg(F.max("length").alias("length"), F.min("length").alias("least"))
    return one.select("chrom", F.when(F.col("length") == F.col("least"), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("two lengths of "), "chrom"))).alias("length"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """old, new: a table with white space between its columns."""
    return spark.read.text(path).where("trim(value) <> ''").selectExpr("split(trim(value), '\\\\s+')[0] AS old", "split(trim(value), '\\\\s+')[1] AS new")


def read_fasta(spark: SparkSession, path: str, chunk: int = 65_536) -> DataFrame:
    """chrom, chunk_no, seq: sequences in chunks of one length."""
    text = spark.read.text(path, wholetext=True)
    records = text.select(F.explode(F.expr("regexp_extract_all(value, '>[^>]*', 0)")).alias("r"))
    seq = records.selectExpr("split(substring_index(substring(r, 2), '\\n', 1), '\\\\s+')[0] AS chrom", "regexp_replace(substring(r, instr(r, '\\n') + 1), '\\\\s+', '') AS seq")
    return _chunks(seq, chunk)


def _chunks(seq: DataFrame, chunk: int) -> DataFrame:
    return seq.select("chrom", "seq", F.explode(F.expr(f"sequence(0L, greatest(length(seq) - 1, 0) div {chunk})")).alias("chunk_no")).selectExpr("chrom", "chunk_no", f"substring(seq, cast(chunk_no * {chunk} + 1 as int), {chunk}) AS seq")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """row_id, label, v: values by spaces, after an optional label and a tab; nan and sparse k:v values, too."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    body = lines.selectExpr("CASE WHEN instr(value, '\\t') > 0 THEN substring_index(value, '\\t', 1) END AS label", "split(trim(substring_index(value, '\\t', -1)), ' +') AS t")
    dense = "transform(t, x -> try_cast(x as double))"
    sparse = "transform(sequence(0, array_max(transform(t, x -> cast(substring_index(x, ':', 1) as int)))), k -> coalesce(try_cast(substring_index(try_element_at(filter(t, x -> x LIKE concat(k, ':%')), 1), ':', -1) as double), 0D))"
    return body.selectExpr("label", f"CASE WHEN instr(t[0], ':') > 0 THEN {sparse} ELSE {dense} END AS v").select(F.monotonically_increasing_id().alias("row_id"), "label", "v")


def as_reg(df: DataFrame, compact: bool = False) -> DataFrame:
    """value: lines of REG."""
    body = "array_join(transform(iv, x -> concat_ws(' ', x.chrom, x.strand, x.start, x.stop)), ' ')"
    if compact:
        body = "concat_ws(' ', iv[0].chrom, iv[0].strand, array_join(transform(iv, x -> x.start), ','), array_join(transform(iv, x -> x.stop), ','))"
    return df.selectExpr("region_id", f"concat(label, '\\t', {body}) AS value")


def as_bed(df: DataFrame, *, color: str = "0,0,0", chr_prefix: bool = False, score: int = 1000) -> DataFrame:
    """value: lines of BED, six columns for single intervals, twelve with blocks else; MT becomes chrM with ``chr_prefix``.

    Every line has the same score and colour; ``as_read`` keeps those of regions from BED.
    """
    chrom = "CASE WHEN iv[0].chrom = 'MT' THEN 'chrM' WHEN iv[0].chrom LIKE 'chr%' THEN iv[0].chrom ELSE concat('chr', iv[0].chrom) END" if chr_prefix else "iv[0].chrom"
    start, end = "array_min(transform(iv, x -> x.start)) - 1", "array_max(transform(iv, x -> x.stop))"
    head = f"{chrom}, {start}, {end}, label, {score}, iv[0].strand"
    blocks = f"{start}, {end}, '{color}', size(iv), array_join(transform(iv, x -> x.stop - x.start + 1), ','), array_join(transform(iv, x -> x.start - ({start}) - 1), ',')"
    return df.selectExpr("region_id", f"CASE WHEN size(iv) = 1 THEN concat_ws('\\t', {head}) ELSE concat_ws('\\t', {head}, {blocks}) END AS value")


def as_wig(df: DataFrame, *, scale: float = 1.0, span: int = 1) -> DataFrame:
    """chrom, start, value: variableStep lines, a header before each chromosome's."""
    rows = df.where("size(iv) = 1").selectExpr("iv[0].chrom AS chrom", "iv[0].start AS start", f"concat(iv[0].start, ' ', format_string('%.6e', coalesce(try_cast(label as double), 0D) * {scale}D)) AS value")
    heads = rows.groupBy("chrom").agg(F.min("start").alias("start")).selectExpr("chrom", "cast(start as bigint) AS start", f"concat('variableStep chrom=', chrom, ' span={span}') AS value", "0 AS nr")
    out = rows.selectExpr("chrom", "start", "value", "1 AS nr").union(heads)
    return out.orderBy("chrom", F.expr("CASE WHEN nr = 0 THEN -1 ELSE start END"), "value").select("chrom", "start", "value")


def as_gff(df: DataFrame) -> DataFrame:
    return df.select("region_id", F.explode("iv").alias("x"), "label", *(["gff"] if "gff" in df.columns else [])).selectExpr("region_id", "concat_ws('\\t', x.chrom, {0}, {1}, x.start, x.stop, {2}, x.strand, {3}, label) AS value".format(*(f"coalesce(gff.{c}, '.')" if "gff" in df.columns else "'.'" for c in ("source", "feature", "score", "frame"))))


def as_seq(df: DataFrame) -> DataFrame:
    return as_reg(df).join(df.select("region_id", "seq"), "region_id").selectExpr("region_id", "concat('>', value, '\\n', seq) AS value")


def as_sam(df: DataFrame) -> DataFrame:
    """Lines of SAM from regions that were read from SAM; the flag's strand follows the intervals'."""
    flag = "CASE WHEN iv[0].strand = '-' THEN sam.flag | 16 ELSE sam.flag & ~16 END"
    cigar = "CASE WHEN size(sam.cigar) = 0 THEN '*' ELSE array_join(transform(sam.cigar, c -> concat(c.len, c.op)), '') END"
    return df.selectExpr("region_id", f"concat_ws('\\t', label, {flag}, iv[0].chrom, iv[0].start, sam.mapq, {cigar}, sam.rnext, sam.pnext, sam.tlen, seq, sam.qual, nullif(sam.optional, '')) AS value")


def track_lines(kind: str, title: str = "", *, color: str = "0,0,0", position: str = "", options: str = "") -> list[str]:
    """The lines before those of ``kind`` (bed, wig or bedgraph): a browser's position and a track's title, where given."""
    head = {"bed": f"track name='{title}' itemRgb=On visibility=1", "wig": f"track type=wiggle_0 name='{title}' color={color} {options}", "bedgraph": f"track type=bedGraph name='{title}' color={color} visibility=1"}[kind]
    return ([f"browser position {position}"] if position else []) + ([head] if title else [])


def as_read(df: DataFrame, *, color: str = "", chr_prefix: bool = False) -> DataFrame:
    """value: regions that were read from BED, with as many columns as they were read with, and what these hold; ``color``, if given, for all."""
    thick, blocks = ["bed.thick_start", "bed.thick_end"], "array_join(transform(iv, x -> {0}), ',')".format
    chrom = "CASE WHEN iv[0].chrom = 'MT' THEN 'chrM' ELSE concat('chr', iv[0].chrom) END" if chr_prefix else "iv[0].chrom"
    columns = [chrom, "iv[0].start - 1", "element_at(iv, -1).stop", "label", "bed.score", "iv[0].strand", *thick, f"'{color}'" if color else "bed.rgb", "size(iv)", blocks("x.stop - x.start + 1"), blocks("x.start - iv[0].start")]
    texts = ", ".join(f"cast({c} AS string)" for c in columns)
    # Seven columns are printed as six, ten and eleven as nine.
    n = "CASE WHEN bed.n_tokens = 7 THEN 6 WHEN bed.n_tokens IN (10, 11) THEN 9 ELSE bed.n_tokens END"
    return df.where("size(iv) > 0").selectExpr("region_id", f"array_join(slice(array({texts}), 1, {n}), '\t') AS value")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def align(df: DataFrame) -> DataFrame:
    """SAM regions with ``ref`` (the reference under the read, from its start): gapped read, reference and qualities, extended CIGAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_gapped(*x) for x in zip(*(b.column(c).to_pylist() for c in ("seq", "ref", "qual", "cigar")), strict=True)]
            yield pa.record_batch([b.column("region_id"), *(pa.array([o[i] for o in out], pa.string()) for i in range(4))], ["region_id", "read", "reference", "extended", "quality"])

    return df.selectExpr("region_id", "seq", "ref", "sam.qual AS qual", "sam.cigar AS cigar").mapInArrow(run, "region_id long, read string, reference string, extended string, quality string")


def _gapped(seq: str, ref: str, qual: str, cigar: list[dict]) -> tuple[str, str, str, str]:
    read, under, quality, ops, i, j = [], [], [], [], 0, 0
    for n, c in ((x["len"], x["op"]) for x in cigar):
        for _ in range(n):
            if c in "M=X":
                ops.append("=" if seq[i].upper() == ref[j].upper() else "X")
                read.append(seq[i]), under.append(ref[j]), quality.append(qual[i] if qual != "*" else "*")
                i, j = i + 1, j + 1
            elif c in "IS":
                ops.append(c)
                read.append(seq[i]), under.append("-"), quality.append(qual[i] if qual != "*" else "*")
                i += 1
            elif c in "DN":
                ops.append(c)
                read.append("-"), under.append(ref[j]), quality.append("-")
                j += 1
            else:
                ops.append(c)
    extended, k = [], 0
    while k < len(ops):
        e = k
        while e < len(ops) and ops[e] == ops[k]:
            e += 1
        extended.append(f"{e - k}{ops[k]}")
        k = e
    return "".join(read), "".join(under), "".join(extended), "".join(quality)
