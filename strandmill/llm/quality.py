"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text becomes a vector of shape statistics (lengths, shares of characters and words of some kind,
repetition), each transformed towards a normal distribution.  For both classes of labelled rows the mean and
the covariance are gathered as distributed sums over all labelled rows (no sample); a covariance shrinks
towards the pooled one and towards its own diagonal.  Cholesky factors are computed once and kept in the
model.  A score is the logistic function of the difference of the log densities (by Mahalanobis distances)
plus the log prior odds, tempered by ``temper`` and, as the statistics of a few words say little, by the
length: a text of ``HALF_WEIGHT`` bytes counts half.

Ids, labels, languages and sources are no inputs.  Null text counts as empty and is scored as any text; rows
without a label, or with a null one, aren't learned from; repeated rows count repeatedly.  Where a class has
fewer than two rows, no densities can be told apart and every score is the share of class 1, or 0.5 without
any labels.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import id_text, rows, saved, tune

FEATURES = ("log_chars", "word_length", "upper", "digit", "mark", "odd_mark", "bar", "long_byte", "distinct", "top_word", "bigrams", "shout", "marked", "lines", "same_lines", "word_spread")
SHRINK_POOLED, SHRINK_DIAGONAL, TEMPER, HALF_WEIGHT = 0.1, 0.1, 4.0, 300.0

_CLASS = np.zeros((256, 6))
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
for _c in b".,;:!?'\"()-":
    _CLASS[_c, 2] = 1
for _c in b"#$%&*@^~_=+<>{}[]\\/`":
    _CLASS[_c, 3] = 1
_CLASS[ord("|"), 4] = 1
_CLASS[128:, 5] = 1


def _logit(share: float, n: int) -> float:
    """Log odds of a share of n things, finite at 0 and 1."""
    k = share * n
    return float(np.log((k + 0.5) / (n - k + 0.5)))


def statistics(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    upper, digit, mark, odd, bar, long_byte = np.bincount(raw, minlength=256)[:256] @ _CLASS
    words = text.split()
    m = len(words)
    sizes = np.fromiter(map(len, words), np.int64, m)
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    shout = sum(map(str.isupper, words))
    marked = m - sum(map(str.isalpha, words))
    lines = [x for x in text.split("\n") if x]
    same = len(lines) - len(set(lines))
    return np.array([
        np.log1p(n), np.log1p(sizes.mean() if m else 0.0), _logit(upper / max(n, 1), n), _logit(digit / max(n, 1), n),
        _logit(mark / max(n, 1), n), _logit(odd / max(n, 1), n), _logit(bar / max(n, 1), n), _logit(long_byte / max(n, 1), n),
        _logit(len(seen) / max(m, 1), m), _logit(max(seen.values(), default=0) / max(m, 1), m), _logit(pairs / max(m - 1, 1), max(m - 1, 0)),
        _logit(shout / max(m, 1), m), _logit(marked / max(m, 1), m), np.log((len(lines) + 1) / (m + 1)), _logit(same / max(len(lines), 1), len(lines)),
        np.log1p(sizes.std() if m else 0.0),
    ])


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array of double, as FEATURES)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and constants of both classes; prior is the share of class 1."""

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    log_dets: tuple[float, ...]
    prior: float
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        logs = [-0.5 * ((((x - m) @ f.T) ** 2).sum(axis=1) + d) for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        chars = np.expm1(x[:, 0])
        odds = (logs[1] - logs[0]) / self.temper * (chars / (chars + HALF_WEIGHT)) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(labelled: DataFrame, *, shrink_pooled: float = SHRINK_POOLED, shrink_diagonal: float = SHRINK_DIAGONAL, temper: float = TEMPER) -> Discriminant:
    """From rows (x, y), y 0 or 1; what comes to the driver is a sum for each class and pair of statistics."""
    d = len(FEATURES)
    rows_ = labelled.where(F.col("y").isin(0, 1)).select("y", F.concat(F.array(F.lit(1.0)), "x").alias("z"))
    sums = {0: np.zeros((d + 1, d + 1)), 1: np.zeros((d + 1, d + 1))}

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros((d + 1, d + 1)), 1: np.zeros((d + 1, d + 1))}
        for b in batches:
            if b.num_rows:
                y = np.array(b.column(0).to_pylist())
                z = np.array(b.column(1).to_pylist(), float)
                for c in total:
                    total[c] += z[y == c].T @ z[y == c]
        i = np.arange((d + 1) ** 2, dtype=np.int32)
        for c, t in total.items():
            yield pa.record_batch([pa.array(np.full(len(i), c, np.int32)), pa.array(i), pa.array(t.ravel())], ["y", "i", "s"])

    for r in rows_.mapInArrow(outer, "y int, i int, s double").groupBy("y", "i").agg(F.sum("s").alias("s")).collect():
        sums[r["y"]].flat[r["i"]] = r["s"]
    n = [sums[c][0, 0] for c in (0, 1)]
    if min(n) < 2:
        return Discriminant((), (), (), n[1] / sum(n) if sum(n) else 0.5, temper)
    means = [sums[c][0, 1:] / n[c] for c in (0, 1)]
    scatter = [sums[c][1:, 1:] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / sum(n)
    factors, dets = [], []
    for c in (0, 1):
        cov = (1 - shrink_pooled) * scatter[c] / n[c] + shrink_pooled * pooled
        cov = (1 - shrink_diagonal) * cov + shrink_diagonal * np.diag(np.diag(cov))
        cov[np.diag_indices(d)] += 1e-3 * np.diag(pooled) + 1e-6
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        dets.append(float(2 * np.log(np.diag(low)).sum()))
    return Discriminant(tuple(means), tuple(factors), tuple(dets), (n[1] + 1) / (sum(n) + 2), temper)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(feats: DataFrame, labels: DataFrame, **how: float) -> Discriminant:
    """A model of labels.quality from the rows that aren't held out."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    return fit(feats.join(y, "doc_id").where(~held_out(F.col("doc_id"))), **how)


def classified(feats: DataFrame, model: Discriminant, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, len(FEATURES))
            s = model.score(x)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = feats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the labels and score every row: doc_id, held_out, score, predicted."""
    feats = saved(features(docs, id_col=id_col, text_col=text_col), "features")
    return classified(feats, learned(feats, labels), threshold)


def good_only(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    feats = saved(features(docs, id_col=id_col, text_col=text_col), "features")
    model = learned(feats, labels)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            if b.num_rows:
                x = np.array([statistics(t or "") for t in b.column(at).to_pylist()])
                yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
