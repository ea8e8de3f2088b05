"""The interval join: an equi-join on bins instead of a nested loop over a range predicate.

Bins come in levels, 2**LEVELS[i] positions wide.  A region's own level is the narrowest whose bins are as long as it
is, so it touches two; the last level takes the longest, which touch more.  A pair meets at the wider of both levels:
each side is exploded to the bins of its own level and of the wider ones that the other side has regions of, which one
small aggregate tells.  Both sides are joined on chromosome, strand, level and bin; a pair stays in the bin that is the
greater of both first bins, so it comes once.  Thus regions of like length cost two rows each, and a few as long as
their chromosome make neither many rows nor a task that holds all others.  AQE splits what is left of skew.

Both sides are sorted and merged.  The smaller one often looks small enough for a broadcast, but the driver would have
to hold it, and walking the many regions of a bin in a broadcast relation takes several times as long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = (9, 12, 15, 18, 22)
_OWN = "CASE " + " ".join(f"WHEN stop - start < {1 << b} THEN {b}" for b in LEVELS[:-1]) + f" ELSE {LEVELS[-1]} END"

_ONE_IV = "array(named_struct('chrom', {0}.chrom, 'strand', {0}.strand, 'start', {0}.start, 'stop', {0}.stop))".format
_OWN_IV = f"coalesce({{0}}.more, {_ONE_IV('{0}')})".format


def flat(df: DataFrame) -> DataFrame:
    """region_id, label, iv and the envelope: chrom, strand, start, stop."""
    return df.selectExpr("region_id", "label", "iv", "iv[0].chrom AS chrom", "iv[0].strand AS strand", "iv[0].start AS start", "element_at(iv, -1).stop AS stop")


def levels(test: DataFrame, ref: DataFrame) -> tuple[list[int], list[int], int, int]:
    """The levels that regions of either side have, and the most intervals of a region of each: a row for each level."""
    both = test.selectExpr("0 AS side", f"{_OWN} AS level", "size(iv) AS n").union(ref.selectExpr("1 AS side", f"{_OWN} AS level", "size(iv) AS n"))
    found = [tuple(r) for r in both.groupBy("side", "level").agg(F.max("n")).collect()]
    return *(sorted(b for s, b, _ in found if s == side) for side in (0, 1)), *(max((n for s, _, n in found if s == side), default=0) for side in (0, 1))


#: Up to so many pairs of intervals are compared one by one, in compiled code; beyond that by functions over arrays.
UNROLLED = 16


def _intervals_meet(n_t: int | None, n_r: int | None) -> str:
    """SQL: intervals of t and r overlap, where either may have more than one; at most n_t and n_r, None if that isn't known."""
    if n_t is None or n_r is None or n_t * n_r > UNROLLED:
        return f"exists({_OWN_IV('t')}, a -> exists({_OWN_IV('r')}, b -> a.start <= b.stop AND a.stop >= b.start))"
    ends = {s: [(f"{s}.start", f"{s}.stop")] if n == 1 else [tuple(f"CASE WHEN {s}.more IS NOT NULL THEN get({s}.more, {i}).{c}{f' ELSE {s}.{c}' if i == 0 else ''} END" for c in ("start", "stop")) for i in range(n)] for s, n in (("t", n_t), ("r", n_r))}
    return " OR ".join(f"({a0} <= {b1} AND {a1} >= {b0})" for a0, a1 in ends["t"] for b0, b1 in ends["r"])


def _binned(df: DataFrame, name: str, keys: list[str], others: list[int], bits: int | None) -> DataFrame:
    """``name`` (a struct, with the intervals only where there are more than one), the keys, level and bin."""
    if bits is not None:
        own, at = f"{bits}", f"transform(sequence(shiftright(start, {bits}), shiftright(stop, {bits})), k -> named_struct('level', {bits}, 'bin', k))"
    else:
        own, widths = _OWN, f"array_distinct(transform(array({', '.join(map(str, others))}), m -> greatest(m, {_OWN})))"
        at = f"flatten(transform({widths}, b -> transform(sequence(shiftright(start, b), shiftright(stop, b)), k -> named_struct('level', b, 'bin', k))))"
    slim = df.selectExpr("region_id", "label", "CASE WHEN size(iv) > 1 THEN iv END AS more", "chrom", "strand", "start", "stop", f"{own} AS own", f"explode({at}) AS at")
    return slim.select(F.struct("region_id", "label", "more", "chrom", "strand", "start", "stop", "own").alias(name), *keys, "at.level", "at.bin")


def interval_join(test: DataFrame, ref: DataFrame, *, stranded: bool = True, gaps: bool = False, bits: int | None = None) -> DataFrame:
    """Pairs (t, r: structs of the columns of ``flat``, and ``one``: a single interval) whose intervals overlap.

    ``gaps``: it is enough that the envelopes overlap.  Regions that start after they stop are passed over.  With
    ``bits`` all bins have that width and nothing is asked of the data beforehand, as streams need it.
    """
    t, r = flat(test).where("start <= stop"), flat(ref).where("start <= stop")
    of_t, of_r, n_t, n_r = levels(t, r) if bits is None else ([], [], None, None)
    merged = bits is None
    if bits is None and len({*of_t, *of_r}) < 2:  # lengths are alike
        bits = max([*of_t, *of_r, LEVELS[0]])
    keys = ["chrom", "strand"] if stranded else ["chrom"]
    right = _binned(r, "r", keys, of_t or LEVELS[:1], bits)
    met = _binned(t, "t", keys, of_r or LEVELS[:1], bits).join(right.hint("merge") if merged else right, [*keys, "level", "bin"])
    if bits is None:
        met = met.where("level = greatest(t.own, r.own)")
    met = met.where("t.start <= r.stop AND t.stop >= r.start AND bin = shiftright(greatest(t.start, r.start), level)")
    if not gaps and (n_t is None or max(n_t, n_r) > 1):
        met = met.where(f"(t.more IS NULL AND r.more IS NULL) OR {_intervals_meet(n_t, n_r)}")
    whole = "named_struct('region_id', {0}.region_id, 'label', {0}.label, 'iv', {1}, 'chrom', {0}.chrom, 'strand', {0}.strand, 'start', {0}.start, 'stop', {0}.stop, 'one', {2}) AS {0}".format
    # Where no region of a side has more than one interval, ``one`` is a constant: what others would need isn't compiled in.
    return met.selectExpr(*[whole(s, _ONE_IV(s), "true") if n is not None and n < 2 else whole(s, _OWN_IV(s), f"{s}.more IS NULL") for s, n in (("t", n_t), ("r", n_r))])
