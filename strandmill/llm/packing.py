"""Packing along a space-filling curve.

A document's token ids are hashed to a vector of a few dimensions (each id adds a fixed pseudo-random vector),
whose quantised coordinates give a key on the Hilbert curve.  Documents are sorted by that key, so that
neighbours in the vector space are neighbours in the order, and the order is cut into sequences of ``size``
tokens.  All sequences are full; what is left at the end of the last is cut into sequences whose lengths are
powers of two, which aren't padded, so there is no padding at all.

Each document is its ids and one end mark; the tokenizer's added tokens count where their text stands in a document.
Null or empty text is the end mark alone.  Ties on the curve are
ordered by a hash of the id, then the id, then the ids' bytes; repeated rows are packed each; an empty table
gives no rows.

Ids are found once and written to the shared folder; they are shuffled once, by ranges of the order, whose number
follows from the bytes of the ids.  Where each range starts follows from the sums of token counts by range, so no task sees more than its range.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import id_text, partitions, rows, saved, tune
from strandmill.llm.pretokens import WHITE, Words

VOCABULARY, END, SIZE = "word_bpe_49k.json", 1, 2048
DIMENSIONS, BITS = 3, 8
#: Bytes of ids in a range of the order, about.
RANGE_BYTES = 128 << 20
#: Bits below the curve's key that part documents of the same key.
TIE_BITS = 28
#: Texts of white space, ASCII and these letters, digits and marks are cut into pre-tokens here; others are left to the tokenizer.
_OTHER = re.compile("[^\t-\r -~¡-įı-ſ]")
_WORD = re.compile(f"[^{WHITE}]+")
#: By code point below 0x180: white space, letter, number, or any other mark.
_WHITE, _LETTER, _NUMBER, _MARK = range(4)
_KIND = np.array([_WHITE if c in range(9, 14) or c == 32 else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _MARK) for c in range(0x180)], np.uint8)
#: Code points that stand for bytes in byte-level vocabularies: themselves where printable, else from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def _contractions(cp: np.ndarray, first: np.ndarray, kind: np.ndarray) -> None:
    """An apostrophe that is a mark of its own takes one of s t m d re ve ll with it; ``first`` marks where pre-tokens start."""
    at = np.flatnonzero((cp == 39) & first)
    at = at[at + 2 < len(cp)]
    one, two = cp[at + 1], cp[at + 2]
    single = np.isin(one, [115, 116, 109, 100])
    double = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
    for chosen, n in ((single, 2), (double, 3)):
        p = at[chosen]
        first[p + 1] = False
        p = p[p + n < len(cp)]
        first[(p + n)[kind[p + n] == _LETTER]] = True


def latin_pieces(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The pre-tokens of texts without _OTHER characters, in lower case, one text after another, and how many each text has."""
    joined = "\n".join([*map(str.lower, texts), ""])
    raw, cp = np.frombuffer(joined.encode(), np.uint8), np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = _KIND[cp]
    first = kind != np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    first |= kind == _NUMBER
    first &= kind != _WHITE
    _contractions(cp, first, kind)
    at = np.flatnonzero(first)
    sizes = (cp > 127).view(np.uint8) + (kind != _WHITE).view(np.uint8)
    ends = np.cumsum(sizes, dtype=np.int64)
    offsets = np.append(ends[at] - sizes[at], ends[-1] if len(ends) else 0).astype(np.int32)
    dense = raw[(raw != 32) & ((raw < 9) | (raw > 13))]
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(dense))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])  # lower case keeps these characters' number
    return pieces, np.diff(np.searchsorted(at, starts))


#: Bytes of pre-tokens, and of other words, that a worker keeps.
KNOWN_BYTES, WORD_BYTES = 160 << 20, 48 << 20


class Encoder:
    """Ids of texts as arrays of unsigned 32-bit integers, as the tokenizer has them.

    Its added tokens are found in the text as it is and part it.  Between them white space is dropped, so words are
    independent of each other.  Latin texts are cut into the tokenizer's own pre-tokens, of which only those of a
    batch that aren't known are merged; words of other texts go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.part = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        # The same merges alone, for pieces that are normalised and cut already.
        self.merges = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
        self.known, self.words = (Words(functools.partial(self._encoded, t), most) for t, most in ((self.merges, KNOWN_BYTES), (self.tokenizer, WORD_BYTES)))

    def _encoded(self, tokenizer, words: list[str]) -> list[bytes]:
        if tokenizer is self.merges and words:  # as the vocabulary writes their bytes; none holds white space
            words = "\n".join(words).encode().decode("latin-1").translate(_BYTES).split(chr(_BYTES[10]))
        ids = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [array("I", x).tobytes() for x in ids]

    def _latin(self, texts: list[str]) -> list[np.ndarray]:
        pieces, n = latin_pieces(texts)
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        # none holds white space; one string is read faster than many
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\n")[0].as_py().split("\n") if len(which) else []
        self.known.learn(names)
        ids = list(map(self.known.__getitem__, names))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        each = size[which]
        ends = np.cumsum(each)
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begin[which] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.cumsum(n)]
        return np.split(flat, cuts[:-1]) if len(texts) else []

    def _others(self, texts: list[str]) -> list[np.ndarray]:
        split = list(map(_WORD.findall, texts))
        self.words.of(split)
        return [np.frombuffer(b"".join(map(self.words.__getitem__, s)), "<u4") for s in split]

    def encode(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, then ``end``."""
        segments, owner, added = [], [], []
        for i, t in enumerate(texts):
            done = 0
            for m in self.part.finditer(t) :
                segments.append(t[done : m.start()])
                added.append(self.added[m.group()])
                owner.append(i)
                done = m.end()
            segments.append(t[done:])
            added.append(end)
            owner.append(i)
        latin = [not _OTHER.search(s) for s in segments]
        found = {True: iter(self._latin([s for s, x in zip(segments, latin, strict=True) if x])), False: iter(self._others([s for s, x in zip(segments, latin, strict=True) if not x]))}
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for i, x, a in zip(owner, latin, added, strict=True):
            out[i] += [next(found[x]), np.array([] if a is None else [a], "<u4")]
        return [np.concatenate(o) for o in out]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def directions(n: int, dimensions: int) -> np.ndarray:
    """A fixed vector for each id, from a hash of the id."""
    x = np.arange(1, n * dimensions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - 1).reshape(n, dimensions)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of cells (a row each), coordinates below 2**bits, by walking down the levels.

    At each level the orthant, in Gray order, gives the next digits; the state is the entry corner and the
    axis along which the sub-curve leaves.
    """
    cells = cells.astype(np.int64)
    d = cells.shape[1]
    full = (1 << d) - 1
    turns = np.zeros(full + 1, np.int64)
    for digit in range(1, full + 1):
        odd = digit if digit % 2 else digit - 1
        turns[digit] = ((~odd & (odd + 1)).bit_length() - 1) % d
    key, entry, axis = (np.zeros(len(cells), np.int64) for _ in range(3))
    for level in range(bits - 1, -1, -1):
        t = (((cells >> level) & 1) << np.arange(d)).sum(axis=1) ^ entry
        r = (axis + 1) % d
        digit = ((t >> r) | (t << (d - r))) & full
        shift = 1
        while shift < d:  # inverse Gray code
            digit = digit ^ (digit >> shift)
            shift <<= 1
        key = (key << d) | digit
        low = np.maximum((digit - 1) // 2 * 2, 0)
        e = low ^ (low >> 1)
        entry = entry ^ (((e << r) | (e >> (d - r))) & full)
        axis = (axis + turns[digit] + 1) % d
    return key


def curve_keys(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Of documents with one id or more each."""
    if not ids:
        return np.zeros(0, np.int64)
    n = np.array([len(x) for x in ids])
    sums = np.add.reduceat(directions(vocabulary, DIMENSIONS)[np.concatenate(ids) % vocabulary], np.cumsum(n) - n, axis=0, dtype=np.float64)
    v = sums / np.sqrt(n / 3)[:, None]
    return hilbert_keys(np.minimum((1 << BITS) / (1 + np.exp(-1.702 * np.clip(v, -30, 30))), (1 << BITS) - 1).astype(np.int64))


def tokenised(docs: DataFrame, *, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place (on the curve, ties parted), n, ids (packed)."""
    path = path or public_tokenizers.path(VOCABULARY)
    tune(docs.sparkSession)
    names = ["doc_id", "curve", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = encoder(path), 1 << 16
        for b in rows(batches, 1024):
            flat = coder.encode(b.column(1).to_pylist(), end)
            # ids below 2**16 take two bytes in the shared folder
            kept = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\0" + x.tobytes() for x in flat]
            yield pa.record_batch([b.column(0), pa.array(curve_keys(flat, known), pa.int64()), pa.array(map(len, flat), pa.int32()), pa.array(kept, pa.binary())], names)

    made = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, curve long, n int, ids binary")
    place = F.shiftleft("curve", TIE_BITS) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << TIE_BITS))
    return made.select("doc_id", place.alias("place"), "n", "ids")


def cuts(total: int, size: int) -> list[int]:
    """Starts of the sequences that follow the last full one, and the end: the rest as powers of two."""
    at = total // size * size
    out = [at]
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        out.append(at)
    return out


def pack(docs: DataFrame, *, size: int = SIZE, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    kept = saved(tokenised(docs, path=path, end=end, id_col=id_col, text_col=text_col), "ids")
    tokens = kept.agg(F.sum("n")).first()[0] or 0
    n = max(partitions(spark), -(-2 * tokens // RANGE_BYTES))
    bounds = sorted({int(b) for b in kept.approxQuantile("place", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    shared = spark.sparkContext.broadcast(np.array(bounds, np.int64))  # a number for each range

    @F.pandas_udf("int")
    def part(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, place.to_numpy(), side="left").astype(np.int32))

    kept = kept.withColumn("part", part("place"))
    sums = {r["part"]: r["n"] for r in kept.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each range
    base, total = [], 0
    for i in range(len(bounds) + 1):
        base.append(total)
        total += sums.get(i, 0)
    tail, whole = cuts(total, size), total // size
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = 0, None
        for b in rows(batches):
            out = []
            for doc_id, part, count, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    at, now = base[part], part
                raw = ids[1:] if len(ids) == 4 * count + 1 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                done = 0
                while done < count:
                    pos = at + done
                    if pos < tail[0]:
                        seq, first, stop = pos // size, pos // size * size, pos // size * size + size
                    else:
                        k = bisect_right(tail, pos) - 1
                        seq, first, stop = whole + k, tail[k], tail[k + 1]
                    length = min(count - done, stop - pos)
                    out.append((doc_id, done, length, zlib.crc32(raw[4 * done : 4 * (done + length)]), count, seq, pos - first))
                    done += length
                at += count
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(7)], names)

    ordered = kept.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "place", "doc_id", "ids")
    return ordered.select("doc_id", "part", "n", "ids").mapInArrow(place, ", ".join(f"{x} long" for x in names))
