"""SQL over a numeric list ``v`` (array<double>); statistics pass over NaN and null, as they count as missing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Present values, and those in order.
CLEAN = "filter(v, x -> x IS NOT NULL AND NOT isnan(x))"
ORDERED = f"array_sort({CLEAN})"


def total(of: str = CLEAN) -> str:
    return f"aggregate({of}, 0D, (s, x) -> s + x)"


def mean(of: str = CLEAN) -> str:
    return f"try_divide({total(of)}, size({of}))"


def sd(of: str = CLEAN) -> str:
    """Of the population, in one pass (a running mean and sum of squared differences)."""
    step = "named_struct('n', a.n + 1, 'm', a.m + (x - a.m) / (a.n + 1), 's', a.s + (x - a.m) * (x - (a.m + (x - a.m) / (a.n + 1))))"
    return f"aggregate({of}, named_struct('n', 0D, 'm', 0D, 's', 0D), (a, x) -> {step}, a -> sqrt(try_divide(a.s, a.n)))"


def once(value: str, name: str, then: str) -> str:
    """``then``, in which ``name`` stands for ``value``: computed once for a row, also inside of lambdas."""
    return f"transform(array({value}), {name} -> {then})[0]"


def trimmed(share: float, of: str = ORDERED) -> str:
    """Without floor(share * n) values on either side."""
    k = f"cast(floor({share} * size({of})) as int)"
    return f"slice({of}, {k} + 1, greatest(size({of}) - 2 * {k}, 0))"


def quantile(q: float, of: str = ORDERED) -> str:
    """With linear interpolation between order statistics (h = (n - 1) q)."""
    h = f"((size({of}) - 1) * {q}D)"
    lo = f"try_element_at({of}, cast(floor({h}) as int) + 1)"
    hi = f"try_element_at({of}, least(cast(floor({h}) as int) + 2, size({of})))"
    return f"CASE WHEN size({of}) > 0 THEN {lo} + ({h} - floor({h})) * ({hi} - {lo}) END"


def log_of(x: str) -> str:
    """Natural logarithm with -Infinity at 0 and NaN below."""
    return f"CASE WHEN {x} > 0 THEN ln({x}) WHEN {x} = 0 THEN double('-Infinity') ELSE double('NaN') END"


def over(a: str, b: str) -> str:
    """Division as floating point has it: by zero an infinity or NaN."""
    return f"CASE WHEN {b} <> 0 OR isnan({b}) THEN {a} / {b} WHEN {a} = 0 OR isnan({a}) THEN double('NaN') WHEN {a} > 0 THEN double('Infinity') ELSE double('-Infinity') END"


_SUM = "aggregate({0}, 0D, (s, x) -> s + x)".format
_ZIP = "zip_with(w.a, w.b, (x, y) -> {0})".format
_E = "aggregate(z, 0D, (s, p) -> s + {0}) / size(z)".format
_MOMENTS = f"named_struct('x', {_E('p.x')}, 'y', {_E('p.y')}, 'xx', {_E('p.x * p.x')}, 'yy', {_E('p.y * p.y')}, 'xy', {_E('p.x * p.y')})"
_PEARSON = once(_MOMENTS, "m", "try_divide(m.xy - m.x * m.y, sqrt((m.xx - m.x * m.x) * (m.yy - m.y * m.y)))")
_BOTH = f"filter({_ZIP("named_struct('x', x, 'y', y)")}, p -> p.x IS NOT NULL AND p.y IS NOT NULL AND NOT isnan(p.x) AND NOT isnan(p.y))"

#: Relations of two lists of one length, as SQL over w.a and w.b.
RELATIONS = {
    "inner": _SUM(_ZIP("x * y")),
    "covariance": f"try_divide({_SUM(_ZIP('x * y'))}, size(w.a))",
    "euclid": f"sqrt({_SUM(_ZIP('(x - y) * (x - y)'))})",
    "pearson": once(_BOTH, "z", f"CASE WHEN size(z) > 0 THEN {_PEARSON} END"),
    "relative_entropy": once(f"named_struct('n', {_SUM('w.a')}, 'm', {_SUM('w.b')})", "t", _SUM(_ZIP("CASE WHEN x > 0 THEN x / t.n * log2(x / t.n / (y / t.m)) ELSE 0D END"))),
    "chi2": f"sqrt({_SUM(_ZIP('try_divide((x - y) * (x - y), y)'))})",
    "hamming": _SUM(_ZIP("CASE WHEN x <=> y THEN 0D ELSE 1D END")),
    "jaccard": "try_divide(size(array_intersect(w.a, w.b)), size(array_union(w.a, w.b)))",
}


def relation(name: str, a: str = "a", b: str = "b") -> str:
    """SQL for the relation ``name`` of the lists ``a`` and ``b``.

    Covariance is the mean product, not centred; in ``pearson`` positions where either is null or NaN don't count.
    """
    return once(f"named_struct('a', {a}, 'b', {b})", "w", RELATIONS[name])


def histogram(bins: int) -> str:
    """Counts of the present values of ``v`` in ``bins`` equal parts of their range; the greatest is in the last."""
    at = f"CASE WHEN c.hi > c.lo THEN least(cast(floor({bins} * (x - c.lo) / (c.hi - c.lo)) as int), {bins - 1}) ELSE 0 END"
    return once(f"named_struct('v', {CLEAN}, 'lo', array_min({CLEAN}), 'hi', array_max({CLEAN}))", "c", f"transform(sequence(0, {bins - 1}), k -> size(filter(c.v, x -> {at} = k)))")


def entropy(bins: int) -> str:
    """Entropy of the histogram as a share of that of ``bins`` equal parts."""
    return once(histogram(bins), "h", once("aggregate(h, 0D, (s, x) -> s + x)", "n", f"aggregate(filter(h, x -> x > 0), 0D, (s, x) -> s - x / n * ln(x / n)) / ln({bins})"))


@pandas_udf(StringType())
def sparse_text(v: pd.Series, start: pd.Series) -> pd.Series:
    """k:x with six digits of the values that are neither zero, null nor NaN.

    The JVM's %.6f rounds the shortest digits that name a number, halves upwards; here its exact value is rounded, as in C.
    """
    return pd.Series([None if xs is None else " ".join(f"{k}:{x:.6f}" for k, x in enumerate(xs.tolist(), first) if x is not None and x == x and x != 0) for xs, first in zip(v, start)], dtype=object)
