"""Places of patterns in sequences, as an Arrow function: all sequences of a batch are compared at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType


def places(patterns: list[str]):
    """A function of a text column: k * s + i for each place k (from 0) of a pattern of the i-th of s sizes; N is any character."""
    sizes = sorted({len(p) for p in patterns})

    def found(seq: pd.Series) -> pd.Series:
        texts = ["" if x is None else x for x in seq]
        text = "".join(texts)
        chars = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in texts])
        codes = []
        for i, n in enumerate(sizes):
            fits = np.zeros(max(len(chars) - n + 1, 0), bool)
            for p in (p for p in patterns if len(p) == n):
                fits |= np.logical_and.reduce([chars[k : len(chars) - n + 1 + k] == ord(c) for k, c in enumerate(p) if c != "N"] or [np.ones_like(fits)]) if len(fits) else fits
            at = np.flatnonzero(fits)
            row = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[row] if len(at) else np.zeros(0, bool)
            codes.append((row[inside], at[inside] * len(sizes) + i))
        row, code = (np.concatenate(x) for x in zip(*codes))
        if len(sizes) > 1:
            order = np.argsort(row, kind="stable")
            row, code = row[order], code[order]
        code = code - (ends[row] - np.array([len(x) for x in texts], np.int64)[row]) * len(sizes)
        return pd.Series(np.split(code, np.searchsorted(row, np.arange(1, len(texts)))) if texts else [], dtype=object)

    return pandas_udf(found, ArrayType(LongType()))
