"""Expressions over a region's array of intervals, ``iv``: array<struct<chrom, strand, start, stop>>.

Coordinates count from 1 and include both ends.  Expressions are Spark SQL, so that they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVAL = "struct<chrom:string,strand:string,start:bigint,stop:bigint>"


def each(start: str = "x.start", stop: str = "x.stop", strand: str = "x.strand", chrom: str = "x.chrom", over: str = "iv") -> str:
    """SQL for the list with every interval x changed; i is its position from 0."""
    return f"transform({over}, (x, i) -> named_struct('chrom', {chrom}, 'strand', {strand}, 'start', cast({start} as bigint), 'stop', cast({stop} as bigint)))"


def size(start: str = "x.start", stop: str = "x.stop") -> str:
    return f"greatest({stop} - {start} + 1, 0)"


#: Sum of the interval sizes.
TOTAL = f"aggregate(iv, 0L, (a, x) -> a + {size()})"
#: From the first interval's start to the last one's stop.
SPAN = "(element_at(iv, -1).stop - element_at(iv, 1).start + 1)"
#: By start, then stop.
SORTED = "array_sort(iv, (a, b) -> CASE WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 WHEN a.stop < b.stop THEN -1 WHEN a.stop > b.stop THEN 1 ELSE 0 END)"


def point(op: str, of: str = "x") -> str:
    """The coordinate that ``op`` names: 1, 2, 5p or 3p."""
    if op in ("1", "2"):
        return f"{of}.{'start' if op == '1' else 'stop'}"
    a, b = ("start", "stop") if op == "5p" else ("stop", "start")
    return f"CASE WHEN {of}.strand = '+' THEN {of}.{a} ELSE {of}.{b} END"


def overlap_length(a0: str, a1: str, b0: str, b1: str) -> str:
    return f"greatest(0, least({a1}, {b1}) - greatest({a0}, {b0}) + 1)"


def weight(label: Column, most: float) -> Column:
    """1 for ``most`` <= 1, else the number that the label starts with (0 if none), ``most`` at most."""
    if most <= 1:
        return F.lit(1.0)
    number = F.regexp_extract(label, r"^\s*([+-]?[0-9]+(?:\.[0-9]*)?)", 1)
    return F.least(F.lit(float(most)), F.coalesce(number.try_cast("double"), F.lit(0.0)))


def reverse_complement(seq: Column) -> Column:
    """IUPAC codes, case kept."""
    return F.reverse(complement(seq))


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn")
