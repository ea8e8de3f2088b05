"""Similarity join of word n-gram sets by adaptive multi-match prefixes.

A document's set holds the distinct n-word shingles of its text, lower-cased from A to Z and cut at
``[\\x20\\x09-\\x0D]``; with fewer words, its whole sequence is the one shingle; without words it is empty and
links with nothing.  Two documents link when
100 * intersection >= percent * union.

Documents of one set are one class, represented once.  Over all sets there is one order of shingles, the rarer
first: two sets that link share at least l of the first n - ceil(n * percent / 100) + l of either (n: its
size).  Each class takes the l whose longer prefix, and fewer documents to verify, cost least by the estimated
frequencies; a pair needs as many shared prefix shingles as the smaller l of the two.

Order: shingles whose hash is in the lowest ``ZONE`` of all hashes, then the others by hash.  In the zone
those come first that a filter of fixed size tells to be in one class only, then other shared ones, and last
those whose frequency, counted over all classes, is in a table of at most ``TABLE`` entries (the most frequent
ones), by frequency.  Filter and table only bear on cost: any order is right.

Lists of a prefix shingle with at most ``LIST`` classes give pairs, which are counted and verified.  Of longer lists,
where near-copies meet in thousands, each class is verified against one of them first.  Lists whose classes all are
connected by then are done.  What remains is cut into blocks of bounded size, whose pairs of blocks are compared whole
by matrix products in one task each, but for pairs that are connected or share an earlier such shingle; only links
that join what isn't joined yet leave the task.  So no list is capped and none gives all its pairs as rows.

Words are hashed by BLAKE2b and shingles have 128 bits, of which 64 find candidates; verification reads the texts
again and compares all 128.

Null text counts as empty; a repeated id gives a row for each of its rows, each with the links of its own
text; a row without an id makes no links, but has the component of its text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import id_text, removed, rows, saved, shared_dir, tune, written
from strandmill.llm.graph import components

ZONE, TABLE, LIST, MATCHES = 0.25, 1 << 20, 48, 4
#: Classes of a long list that meet its centre in one key.
SHARE = 256
#: Classes and shingles in a block of a long list; estimated cost of verifying a pair, in posting entries.
BLOCK, BLOCK_SHINGLES, VERIFY = 2048, 1 << 20, 8.0
#: Bits of the filter through which the second reading of the texts goes; its size doesn't grow.
FILTER_BITS = 1 << 23
#: Bits of the filter of shingles that two classes share; the fuller it is, the more others pass, to no effect.
SHARED_BITS = 1 << 27

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd factors by which either half of a shingle's hash takes in the next word's.
_STEPS = np.array([0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(data: np.ndarray, space: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits (two columns) of each word, from BLAKE2b; every distinct word of the batch is hashed once."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]).dictionary_encode()
    names = words.dictionary.to_numpy(zero_copy_only=False)
    digests = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in names])
    return np.frombuffer(digests, "<u8").reshape(-1, 2)[words.indices.to_numpy()]


def _distinct(h: np.ndarray) -> np.ndarray:
    """Sorted by the first column, then the second; each row once."""
    h = h[np.argsort(h[:, 0], kind="stable")]
    same = h[1:, 0] == h[:-1, 0]
    if (same & (h[1:, 1] != h[:-1, 1])).any():
        h = h[np.lexsort((h[:, 1], h[:, 0]))]
        same = (h[1:] == h[:-1]).all(axis=1)
    return h[np.concatenate([[True], ~same])] if len(h) else h


def shingle_sets(texts: list[str], n: int = 4) -> list[np.ndarray]:
    """The distinct shingles of each text as 128-bit hashes: rows of two numbers, in order."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() is A to Z alone
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = _word_hashes(data, space, stop - start)
    first = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    joined = word[: max(0, len(word) - n + 1)].copy()
    for k in range(1, n):
        joined = _mix(joined * _STEPS + word[k : k + len(joined)])
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(_distinct(joined[a : b - n + 1]))
        elif b > a:
            h = word[a : a + 1]
            for k in range(a + 1, b):
                h = _mix(h * _STEPS + word[k : k + 1])
            out.append(_mix(h + _U(b - a)))
        else:
            out.append(np.zeros((0, 2), np.uint64))
    return out


def _signature(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _short(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about a million characters, for the arrays that shingling needs."""
    for b in rows(batches):
        sizes = np.array([len(t) for t in b.column(column).to_pylist()], np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        for i, j in zip([0, *cut], [*cut, b.num_rows], strict=True):
            yield b.slice(int(i), int(j - i))


def needed_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def choose(frequency: np.ndarray, n: int, percent: int, most: int = MATCHES) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost; ``frequency``: of the set's shingles in order, as far as known.

    A prefix reads its lists; by Markov's inequality at most sum / l documents share l or more with it.
    """
    need = needed_overlap(n, percent)
    others = np.cumsum(np.maximum(frequency - 1.0, 0.0))
    best = None
    for m in range(1, min(most, need) + 1):
        length = n - need + m
        read = others[length - 1]
        cost = read + VERIFY * read / m
        if best is None or cost < best[0]:
            best = (cost, m, length)
    return best[1], best[2]


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, sig) of every row; (sig, rep) and the prefixes of every class that isn't empty.

    Both tables that hold shingles of all texts are deleted as soon as the next one is written.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    limit = _U(int(ZONE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _short(batches, 1):
            sets = shingle_sets(b.column(1).to_pylist(), n)
            sig = list(map(_signature, sets))
            sets = [np.ascontiguousarray(s[:, 0]) for s in sets]  # half a hash finds candidates; verification has all of it
            keep = [max(int(np.searchsorted(s, limit)), min(len(s), len(s) - needed_overlap(len(s), percent) + MATCHES)) for s in sets]
            yield pa.record_batch([b.column(0), pa.array(map(len, sets), pa.int64()), pa.array(sig, pa.binary()), pa.array([s[:k].tobytes() for s, k in zip(sets, keep, strict=True)], pa.binary())], ["doc_id", "n", "sig", "zone"])

    sets = written(docs.mapInArrow(run, "doc_id long, n long, sig binary, zone binary"), f"{folder}/sets")
    base = saved(sets.select("doc_id", "n", "sig"), "base")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.first("zone").alias("zone"))
    classes = written(classes, f"{folder}/classes")
    removed(spark, f"{folder}/sets")
    reps, posts = saved(classes.select("sig", "rep"), "reps"), saved(_prefixes(classes, percent), "prefixes")
    removed(spark, f"{folder}/classes")
    return base, reps, posts


def _bits(numbers: DataFrame, size: int) -> np.ndarray:
    """A bit for every ``bit`` (from 0 to size - 1) of ``numbers``; size / 8 bytes come to the driver, however many numbers there are."""
    bit = F.col("bit") + 1  # Spark's bitmaps count buckets from 1 for numbers from 1
    got = numbers.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in got:
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _test(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _frequencies(classes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles of the zone, sorted, their counts, and a filter of all that are in two classes or more."""
    limit = _U(int(ZONE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            z = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
            yield pa.record_batch([pa.array(z[z < limit].view(np.int64))], ["token"])

    counts = classes.select("zone").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").cast("int").alias("c")).where("c > 1")
    counts = saved(counts, "frequencies")
    shared = _bits(counts.select(F.col("token").bitwiseAND(SHARED_BITS - 1).alias("bit")), SHARED_BITS)
    least, room = 2, TABLE
    by_size = sorted((tuple(r) for r in counts.groupBy("c").count().collect()), reverse=True)  # a row for each frequency
    for c, k in by_size:
        room -= k
        if room < 0:
            least = c + 1
            break
    t = counts.where(F.col("c") >= least).toArrow()
    tokens, c = t.column("token").to_numpy().view(np.uint64), t.column("c").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], c[order], shared


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(token, sig, n, l): the prefix shingles of every class, without most of those that no other class has."""
    table = classes.sparkSession.sparkContext.broadcast(_frequencies(classes))  # at most TABLE entries and SHARED_BITS
    limit = _U(int(ZONE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, freq, shared = table.value
        for b in rows(batches):
            out: list[list] = [[], [], [], []]
            for sig, n, zone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                z = np.frombuffer(zone, np.uint64)
                at = np.minimum(np.searchsorted(known, z), max(len(known) - 1, 0))
                found = known[at] == z if len(known) else np.zeros(len(z), bool)
                inside = z < limit
                common = ~inside | _test(shared, (z & _U(SHARED_BITS - 1)).astype(np.int64))
                f = np.where(common, 2, 1)
                if len(known):
                    f = np.where(found, freq[at], f)
                order = np.lexsort((z, f, found, ~inside))
                z, f, common = z[order], f[order], common[order]
                m, length = choose(f, n, percent)
                own = z[:length][common[:length]].view(np.int64)
                out[0].append(own)
                out[1] += [sig] * len(own)
                out[2].append(np.full(len(own), n, np.int64))
                out[3].append(np.full(len(own), m, np.int32))
            cols = [np.concatenate(out[i]) if out[i] else np.zeros(0, kind) for i, kind in ((0, np.int64), (2, np.int64), (3, np.int32))]
            yield pa.record_batch([pa.array(cols[0]), pa.array(out[1], pa.binary()), pa.array(cols[1]), pa.array(cols[2])], ["token", "sig", "n", "l"])

    return classes.select("sig", "n", "zone").mapInArrow(run, "token long, sig binary, n long, l int")


def _texts_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sig, text) for ``wanted`` (sig, rep): texts are read again, those that a filter of fixed size lets through."""
    bits = _bits(wanted.select(F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)).alias("bit")), FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for b in rows(batches):
            through = _test(have, b.column(1).to_numpy())
            for c in _short([b.filter(pa.array(through))], 0):
                texts = c.column(0)
                yield pa.record_batch([pa.array(map(_signature, shingle_sets(texts.to_pylist(), n)), pa.binary()), texts], ["sig", "text"])

    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    texts = docs.select("text", place.alias("place")).mapInArrow(run, "sig binary, text string")
    # Equal sig, equal set: whichever document let through has it; the aggregation keeps the join's partitions.
    return texts.join(wanted.select("sig"), "sig", "left_semi").groupBy("sig").agg(F.first("text").alias("text"))


def _codes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all shingles of all sets, one after another: a number, equal for equal shingles; its owner; and in how many sets each number is."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    new = np.concatenate([[True], (flat[order[1:]] != flat[order[:-1]]).any(axis=1)])[: len(flat)]
    code = np.empty(len(flat), np.int64)
    code[order] = np.cumsum(new) - 1
    return code, owner, np.bincount(code)


def links_within(ids: list, sets: list[np.ndarray], parts: np.ndarray, hot: list[np.ndarray], token: int, side: np.ndarray, percent: int) -> list[tuple]:
    """Links between the documents of two blocks (side 0 and 1; one block: all 0), as a forest.

    Passed over: pairs of one part, which are connected already, pairs whose sizes can't reach the threshold, and pairs
    that share a hot shingle below ``token``.
    """
    n = np.array([len(s) for s in sets], float)
    rows_ = np.flatnonzero(side == 0)
    cols = np.flatnonzero(side == 1) if (side == 1).any() else rows_
    same = cols is rows_
    todo = 100 * np.minimum.outer(n[rows_], n[cols]) >= percent * np.maximum.outer(n[rows_], n[cols])
    todo &= parts[rows_][:, None] != parts[cols][None, :]
    if same:
        todo &= np.triu(np.ones_like(todo), 1)
    below = [h[h < token] for h in hot]
    names = np.unique(np.concatenate(below)) if below else np.zeros(0, np.int64)
    if len(names):
        inc = np.zeros((len(ids), len(names)), np.float32)
        for i, h in enumerate(below):
            inc[i, np.searchsorted(names, h)] = 1
        todo &= inc[rows_] @ inc[cols].T == 0
    left, right = todo.any(axis=1), todo.any(axis=0)
    rows_, cols, todo = rows_[left], cols[right], todo[left][:, right]
    if not todo.any():
        return []
    use = np.union1d(rows_, cols)
    code, owner, count = _codes([sets[i] for i in use])
    often = count > 1
    new = np.cumsum(often) - 1
    keep = often[code]
    code, owner = new[code[keep]], owner[keep]
    r, c = np.searchsorted(use, rows_), np.searchsorted(use, cols)
    both = np.zeros((len(r), len(c)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step = 4096
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, [lo, lo + step])
        m = np.zeros((len(use), step), np.float32)
        m[owner[a:b], code[a:b] - lo] = 1
        both += m[r] @ m[c].T
    union = n[rows_][:, None] + n[cols][None, :] - both
    parent = list(range(len(ids)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(todo & (100 * both.astype(float) >= percent * union)), strict=True):
        a, b = find(int(rows_[i])), find(int(cols[j]))
        if a != b:
            parent[b] = a
            out.append((ids[int(rows_[i])], ids[int(cols[j])]))
    return out


def _links(docs: DataFrame, reps: DataFrame, posts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): enough links between classes to connect all that links connect."""
    lists = posts.groupBy("token").agg(F.count("*").alias("c"), F.sum("n").alias("total")).where("c > 1")
    posts = saved(posts.join(lists, "token"), "lists")

    few = posts.where(F.col("c") <= LIST)
    x, y = (few.select("token", F.col("sig").alias(f"sig_{s}"), F.col("n").alias(f"n_{s}"), F.col("l").alias(f"l_{s}")) for s in "ab")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = x.join(y, "token").where((F.col("sig_a") < F.col("sig_b")) & fits)
    pairs = pairs.groupBy("sig_a", "sig_b").agg(F.count("*").alias("k"), F.least(F.min("l_a"), F.min("l_b")).alias("l")).where("k >= l")
    pairs = saved(pairs.select("sig_a", "sig_b"), "pairs")

    many = posts.where(F.col("c") > LIST)
    wanted = pairs.select(F.col("sig_a").alias("sig")).union(pairs.select("sig_b")).union(many.select("sig")).distinct()
    texts = saved(_texts_of(docs, wanted.join(reps, "sig"), n), "texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 64):
            both = [c.to_pylist() for c in b.columns[2:]]
            names = list(dict.fromkeys(both[0] + both[1]))
            sets = dict(zip(names, [s for c in _short([pa.record_batch([pa.array(names, pa.string())], ["t"])], 0) for s in shingle_sets(c.column(0).to_pylist(), n)], strict=True))
            ok = []
            for p, q in zip(*both, strict=True):
                p, q = sets[p], sets[q]
                shared = int((_codes([p, q])[2] > 1).sum())
                ok.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield pa.record_batch(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    named = lambda s: texts.select(F.col("sig").alias(f"sig_{s}"), F.col("text").alias(f"text_{s}"))
    found = pairs.join(named("a"), "sig_a").join(named("b"), "sig_b")

    # Each class of a long list against one of the list, which a hash chooses: where these are near-copies, all are connected then.
    centre = many.groupBy("token").agg(F.min_by(F.struct("sig", "n"), F.xxhash64("sig", "token")).alias("p"), F.first("c").alias("c"))
    shares = F.ceil(F.col("c") / SHARE).cast("int")  # no key of the join below has much more than SHARE rows
    centre = centre.select("token", shares.alias("shares"), F.col("p.sig").alias("sig_b"), F.col("p.n").alias("n_b")).join(named("b"), "sig_b")
    centre = centre.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    around = many.select("token", F.col("sig").alias("sig_a"), F.col("n").alias("n_a"), F.pmod(F.xxhash64("sig"), shares).cast("int").alias("share")).join(named("a"), "sig_a")
    stars = around.join(centre, ["token", "share"]).where((F.col("sig_a") != F.col("sig_b")) & fits)
    columns = ["sig_a", "sig_b", "text_a", "text_b"]
    linked = components(found.select(*columns).union(stars.select(*columns)).mapInArrow(verify, "a binary, b binary"))
    linked = saved(linked, "linked")

    part = F.coalesce("root", "sig").alias("part")
    many = saved(many.join(linked.select(F.col("node").alias("sig"), "root"), "sig", "left").select("token", "sig", "n", part), "long")
    lists = many.groupBy("token").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.min("part").alias("least"), F.max("part").alias("most"))
    lists = lists.where("least <> most").drop("least", "most")
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    cut = many.join(lists, "token").select("token", "sig", "part", blocks.alias("blocks"))
    hot = cut.groupBy("sig").agg(F.collect_list("token").alias("hot"))  # of a prefix
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("sig", "token"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("token", "sig", "part", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    cut = cut.join(texts.join(hot, "sig"), "sig")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if int(key[1]) != int(key[2]) and pdf["side"].nunique() < 2 or pdf["part"].nunique() < 2:
            return pd.DataFrame({"a": [], "b": []})
        sets = [s for c in _short([pa.record_batch([pa.array(pdf["text"], pa.string())], ["t"])], 0) for s in shingle_sets(c.column(0).to_pylist(), n)]
        parts = pd.factorize(pdf["part"])[0]
        out = links_within(list(pdf["sig"]), sets, parts, [np.array(h, np.int64) for h in pdf["hot"]], int(key[0]), pdf["side"].to_numpy(), percent)
        return pd.DataFrame(out, columns=["a", "b"])

    dense = cut.groupBy("token", "i", "j").applyInPandas(compare, "a binary, b binary")
    return linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(dense)


def ngram_join(docs: DataFrame, *, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    tune(docs.sparkSession)
    source = id_text(docs, id_col, text_col)
    base, reps, posts = _classes(source, words, percent)
    member = components(_links(source, reps, posts, words, percent))
    of = reps.join(member.select(F.col("node").alias("sig"), "root"), "sig", "left")
    of = of.withColumn("root", F.coalesce("root", "sig"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = saved(of.join(least, "root").select("sig", "component_id"), "components")
    out = base.join(of, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all their columns."""
    stay = ngram_join(docs, words=words, percent=percent, id_col=id_col, text_col=text_col).where("doc_id = component_id or doc_id is null")
    stay = stay.select(F.col("doc_id").alias("__stay")).distinct()
    return docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("__stay")), "left_semi")
