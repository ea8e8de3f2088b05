"""Per-region transforms: projections over the interval list; no shuffle, legal on streams.

Input: region_id, label, iv and any further columns.  A region without intervals left is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.places import places
from strandmill.functions.regions import SORTED, SPAN, TOTAL, each, point, reverse_complement, size


def _put(df: DataFrame, expr: str) -> DataFrame:
    return df.withColumn("iv", F.expr(expr)).where("size(iv) > 0")


def center(df):
    """The middle of every interval, two positions where its size is even."""
    half = "(x.stop - x.start) div 2"
    return _put(df, each(f"x.start + {half}", f"x.stop - {half}"))


def connect(df):
    """One interval from the least start to the greatest stop."""
    return _put(df, each("array_min(transform(iv, y -> y.start))", "array_max(transform(iv, y -> y.stop))", over="slice(iv, 1, 1)"))


def diff(df):
    """The gaps between successive intervals."""
    gaps = each("iv[i].stop + 1", "x.start - 1", "iv[i].strand", "iv[i].chrom", over="slice(iv, 2, greatest(size(iv) - 1, 0))")
    return _put(df, f"filter({gaps}, x -> x.start <= x.stop)")


def dist(df, op1="1", op2="1"):
    """Distances from each interval's point op1 to the next one's point op2; null across chromosomes."""
    step = f"transform(slice(iv, 2, greatest(size(iv) - 1, 0)), (x, i) -> CASE WHEN x.chrom = iv[i].chrom THEN ({point(op2)}) - ({point(op1, 'iv[i]')}) END)"
    return df.withColumn("distances", F.expr(step)).where("size(iv) > 1")


def divide(df):
    """Both halves of every interval of two positions or more."""
    s = "named_struct('chrom', x.chrom, 'strand', x.strand, 'start', {0}, 'stop', {1})".format
    middle = f"x.start + ({size()}) div 2"
    halves = f"array({s('x.start', f'{middle} - 1')}, {s(middle, 'x.stop')})"
    return _put(df, f"flatten(transform(iv, x -> CASE WHEN {size()} >= 2 THEN {halves} ELSE array(x) END))")


def fix(df):
    """Without intervals that start before 1 or stop before they start."""
    return _put(df, "filter(iv, x -> x.start >= 1 AND x.start <= x.stop)")


def intersection(df):
    """What all intervals of a region share."""
    one = each("array_max(transform(iv, y -> y.start))", "array_min(transform(iv, y -> y.stop))", over="slice(iv, 1, 1)")
    return _put(df, f"filter({one}, x -> x.start <= x.stop AND size(array_distinct(transform(iv, y -> y.chrom))) = 1)")


def n(df):
    """The sum of the sizes, overlaps counted twice."""
    return df.withColumn("n", F.expr(TOTAL))


def pos(df, op="1", shift=0):
    """The point op, with ``shift`` positions inwards of it, or ``shift`` on either side of the centre (c)."""
    if op == "c":
        mid = f"x.start + ({size()}) div 2"
        return _put(df, each(f"{mid} - {shift}", f"{mid} + {shift}"))
    at_start = {"1": "true", "2": "false", "5p": "x.strand = '+'", "3p": "x.strand = '-'"}[op]
    return _put(df, each(f"CASE WHEN {at_start} THEN x.start ELSE x.stop - {shift} END", f"CASE WHEN {at_start} THEN x.start + {shift} ELSE x.stop END"))


def shift(df, start=0, stop=0):
    return _put(df, each(f"x.start + {start}", f"x.stop + {stop}"))


def shiftp(df, five=0, three=0):
    """Offsets of the 5' and the 3' end, along the strand."""
    return _put(df, each(f"CASE WHEN x.strand = '-' THEN x.start - {three} ELSE x.start + {five} END", f"CASE WHEN x.strand = '-' THEN x.stop - {five} ELSE x.stop + {three} END"))


def select(df, first=False, last=False, five=False, three=False):
    """The first and / or the last interval in order, or at an end by strand; no flag: nothing stays."""
    s = f"({SORTED})"
    head = f"({str(first).lower()} OR ({str(five).lower()} AND iv[0].strand = '+') OR ({str(three).lower()} AND iv[0].strand = '-'))"
    tail = f"({str(last).lower()} OR ({str(five).lower()} AND iv[0].strand = '-') OR ({str(three).lower()} AND iv[0].strand = '+'))"
    return _put(df, f"CASE WHEN size(iv) = 1 THEN filter(iv, x -> {head} OR {tail}) ELSE concat(CASE WHEN {head} THEN slice({s}, 1, 1) ELSE slice(iv, 1, 0) END, CASE WHEN {tail} THEN slice({s}, -1, 1) ELSE slice(iv, 1, 0) END) END")


def sort(df):
    return _put(df, SORTED)


def split(df, by_chrom_strand=False):
    """A region for every interval, or for every chromosome and strand; ``part`` counts from 0."""
    if not by_chrom_strand:
        return df.select("*", F.posexplode("iv").alias("part", "x")).withColumn("iv", F.array("x")).drop("x")
    groups = "array_distinct(transform(iv, x -> struct(x.chrom, x.strand)))"
    out = df.select("*", F.posexplode(F.expr(groups)).alias("part", "g"))
    return _put(out, "filter(iv, x -> x.chrom = g.chrom AND x.strand = g.strand)").drop("g")


def strand(df, op="r", ordered=False):
    """Set the strand to + or -, or reverse it (r)."""
    new = "CASE WHEN x.strand = '+' THEN '-' ELSE '+' END" if op == "r" else f"'{op}'"
    out = _put(df, each(strand=new))
    return out.orderBy(F.expr("iv[0].chrom"), F.expr("iv[0].strand"), F.expr("iv[0].start")) if ordered else out


def union(df):
    """Overlapping intervals merged, adjacent ones not."""
    s = "named_struct('chrom', x.chrom, 'strand', x.strand, 'start', {0}, 'stop', {1})".format
    last = "element_at(a, -1)"
    merged = f"concat(slice(a, 1, size(a) - 1), array({s(f'{last}.start', f'greatest({last}.stop, x.stop)')}))"
    return _put(df, f"aggregate({SORTED}, slice(iv, 1, 0), (a, x) -> CASE WHEN size(a) > 0 AND x.start <= {last}.stop AND x.chrom = {last}.chrom THEN {merged} ELSE concat(a, array({s('x.start', 'x.stop')})) END)")


def win(df, size_, step, small=False):
    """Sliding windows over single intervals, labelled L#1, L#2, ...; with ``small`` also the cut ones at the end."""
    end = "iv[0].stop" if small else f"iv[0].stop - {size_} + 1"
    starts = F.expr(f"CASE WHEN {end} >= iv[0].start THEN sequence(iv[0].start, {end}, {step}L) ELSE array() END")
    out = df.where("size(iv) = 1").select("*", F.posexplode(starts).alias("part", "z"))
    out = out.withColumn("label", F.concat("label", F.lit("#"), (F.col("part") + 1).cast("string")))
    return _put(out, each("z", f"least(z + {size_} - 1, x.stop)")).drop("z")


def bounds(df, genome):
    """Clipped to [1, length] of the chromosome; what lies outside, or on an unknown chromosome, goes.

    The bounds, a row for each chromosome, become one map value: their number doesn't grow with the regions.
    """
    lengths = genome.agg(F.map_from_entries(F.collect_list(F.struct("chrom", "length"))).alias("lengths"))
    clipped = each("greatest(x.start, 1)", "least(x.stop, lengths[x.chrom])", over="filter(iv, y -> map_contains_key(lengths, y.chrom))")
    return _put(df.join(F.broadcast(lengths)), f"filter({clipped}, x -> x.start <= x.stop)").drop("lengths")


def chrom(df, names):
    """Chromosomes renamed by a table (old, new); others stay."""
    table = names.agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("names"))
    return _put(df.join(F.broadcast(table)), each(chrom="coalesce(names[x.chrom], x.chrom)")).drop("names")


def rnd(df, genome, seed=0):
    """A uniform place inside the chromosome for every region, with its gaps; by a hash of region and seed."""
    lengths = genome.agg(F.map_from_entries(F.collect_list(F.struct("chrom", "length"))).alias("lengths"))
    room = f"(lengths[iv[0].chrom] - {SPAN} + 1)"
    out = df.join(F.broadcast(lengths)).where(f"{room} > 0").withColumn("by", F.expr(f"pmod(xxhash64(region_id, {seed}), {room}) + 1 - iv[0].start"))
    return _put(out, each("x.start + by", "x.stop + by")).drop("by", "lengths")


def shuffle(df, ref, seed=0):
    """A uniform place inside the reference regions of the same chromosome and strand, laid end to end.

    A region that crosses from one piece to the next gives a row for each piece.
    """
    pieces = ref.select(F.explode("iv").alias("p")).select("p.*").distinct()
    w = W.partitionBy("chrom", "strand").orderBy("start", "stop")
    pieces = pieces.withColumn("n", F.expr("stop - start + 1"))
    pieces = pieces.withColumn("from", F.sum("n").over(w) - F.col("n"))
    room = pieces.groupBy("chrom", "strand").agg(F.sum("n").alias("room"))
    src = df.where("size(iv) = 1").select("region_id", "label", F.expr("iv[0].chrom").alias("chrom"), F.expr("iv[0].strand").alias("strand"), F.expr("iv[0].stop - iv[0].start + 1").alias("len"))
    src = src.join(room, ["chrom", "strand"]).where("room >= len").withColumn("at", F.expr(f"pmod(xxhash64(region_id, {seed}), room - len + 1)"))
    src = src.select("*", F.explode(F.expr("sequence(at div 4096, (at + len - 1) div 4096)")).alias("bin"))
    bins = pieces.select("*", F.explode(F.expr("sequence(from div 4096, (from + n - 1) div 4096)")).alias("bin"))
    met = src.join(bins, ["chrom", "strand", "bin"]).where("at < from + n AND from < at + len AND bin = greatest(at div 4096, from div 4096)")
    return met.select("region_id", "label", F.expr("array(named_struct('chrom', chrom, 'strand', strand, 'start', start + greatest(at, from) - from, 'stop', start + least(at + len, from + n) - 1 - from))").alias("iv"))


def extract(df, sequences, replace_n=False):
    """Spliced sequence of every region, reverse-complemented on '-'; ``sequences``: chrom, chunk_no, seq in chunks of one length."""
    size_ = sequences.agg(F.max(F.length("seq"))).first()[0] or 1
    parts = df.select("region_id", F.posexplode("iv").alias("k", "x")).select("region_id", "k", "x.*", F.explode(F.expr(f"sequence((x.start - 1) div {size_}, (x.stop - 1) div {size_})")).alias("chunk_no"))
    met = parts.join(sequences, ["chrom", "chunk_no"])
    piece = F.expr(f"substring(seq, cast(greatest(start - chunk_no * {size_}, 1) as int), cast(least(stop - chunk_no * {size_}, {size_}) - greatest(start - chunk_no * {size_}, 1) + 1 as int))")
    whole = met.withColumn("piece", piece).groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct("k", "chunk_no", "piece"))).alias("p"))
    out = df.join(whole, "region_id").withColumn("seq", F.array_join(F.transform("p", lambda p: p["piece"]), "")).drop("p")
    out = out.withColumn("seq", F.when(F.expr("iv[0].strand = '-'"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    return out.withColumn("seq", F.translate("seq", "Nn", "aa")) if replace_n else out


def search(df, pattern):
    """Every place of a region's ``seq`` where an alternative of the bar-separated pattern stands (N: any), strand aware."""
    patterns = [p for p in pattern.split("|") if p]
    sizes = sorted({len(p) for p in patterns})
    if not sizes:
        return df.where("false")
    out = df.where("size(iv) = 1").select("*", F.explode(places(patterns)("seq")).alias("p"))
    out = out.withColumn("h", F.expr(f"struct(p div {len(sizes)} + 1 AS at, element_at(array({', '.join(f'{n}L' for n in sizes)}), cast(p % {len(sizes)} as int) + 1) AS len)")).drop("p")
    return _put(out, each("CASE WHEN x.strand = '-' THEN x.stop - h.at - h.len + 2 ELSE x.start + h.at - 1 END", "CASE WHEN x.strand = '-' THEN x.stop - h.at + 1 ELSE x.start + h.at + h.len - 2 END")).drop("h")


def length_without_n(df):
    """``seq`` needed: its length without N."""
    return df.withColumn("n", F.length(F.translate("seq", "Nn", "")))


def no_n(df):
    """``seq`` needed: a region for each run without N in an interval, numbered by ``part`` along the sequence."""
    size_, before = "(x.stop - x.start + 1)", "aggregate(slice(iv, 1, k), 0L, (s, y) -> s + y.stop - y.start + 1)"
    pieces = df.where("length(seq) > 0").select("*", F.posexplode("iv").alias("k", "x"))
    at = f"CASE WHEN x.strand = '-' THEN length(seq) - {before} - {size_} ELSE {before} END"
    pieces = pieces.withColumn("at", F.expr(at)).withColumn("piece", F.expr(f"substring(seq, cast(at + 1 as int), cast({size_} as int))"))
    starts = "transform(filter(sequence(1, length(piece)), p -> chars[p - 1] NOT IN ('N', 'n') AND (p = 1 OR chars[p - 2] IN ('N', 'n'))), p -> cast(p as bigint))"
    out = pieces.withColumn("chars", F.split("piece", "")).withColumns({"starts": F.expr(starts), "runs": F.expr("regexp_extract_all(piece, '[^Nn]+', 0)")})
    out = out.select("*", F.explode(F.arrays_zip("starts", "runs")).alias("h")).withColumn("n", F.expr("length(h.runs)"))
    start = "CASE WHEN x.strand = '-' THEN x.stop - h.starts - n + 2 ELSE x.start + h.starts - 1 END"
    out = out.withColumn("iv", F.expr(f"array(named_struct('chrom', x.chrom, 'strand', x.strand, 'start', {start}, 'stop', {start} + n - 1))"))
    return out.withColumns({"seq": F.col("h.runs"), "part": F.expr("at + h.starts")}).drop("k", "x", "at", "piece", "h", "starts", "runs", "n", "chars")


def verify(df):
    """``seq`` needed: does the label say what stands there, on this strand or the other?"""
    return df.withColumns({"forward": F.upper("label") == F.upper("seq"), "backward": F.upper("label") == F.upper(reverse_complement(F.col("seq")))})


def rc(df, genome):
    """Coordinates of '-' intervals mirrored by the chromosome's length."""
    lengths = genome.agg(F.map_from_entries(F.collect_list(F.struct("chrom", "length"))).alias("lengths"))
    m = "lengths[x.chrom] + 1"
    return _put(df.join(F.broadcast(lengths)), each(f"CASE WHEN x.strand = '-' THEN {m} - x.stop ELSE x.start END", f"CASE WHEN x.strand = '-' THEN {m} - x.start ELSE x.stop END")).drop("lengths")


def meet(df, other="other"):
    """What the intervals share with those of ``other`` (a column of intervals), pair by pair, on equal chromosome and strand."""
    both = each(f"greatest(x.start, {other}[j].start)", f"least(x.stop, {other}[j].stop)", over=f"filter(iv, x -> x.chrom = {other}[j].chrom AND x.strand = {other}[j].strand)")
    met = f"filter(flatten(transform(sequence(0, size({other}) - 1), j -> {both})), x -> x.start <= x.stop)"
    return _put(df.where(f"size({other}) > 0"), SORTED.replace("array_sort(iv,", f"array_sort({met},"))


def clip(df, other="other"):
    """Every interval cut to the span from the first start to the last stop of ``other``."""
    return _put(df, f"filter({each(f'greatest(x.start, {other}[0].start)', f'least(x.stop, element_at({other}, -1).stop)')}, x -> x.start <= x.stop)")


def between(df, other="other"):
    """From behind the first interval of ``other`` to before the region's own first: one interval, which may be empty (start after stop)."""
    return df.withColumn("label", F.lit("_")).withColumn("iv", F.expr(each(f"{other}[0].stop + 1", "x.start - 1", over="slice(iv, 1, 1)")))
