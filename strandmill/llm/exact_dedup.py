"""Exact deduplication by an extendible-hash index on shared files.

Built from DataFrame functions only.  Texts are equal when they are identical without white space
(``[\\x20\\x09-\\x0D]``).  A key is the 64-bit hash of that text; its leading bits choose a slot of a
directory, and slots that no split has parted share a bucket.  A bucket with more than ``capacity`` keys
splits in two, and the directory doubles when a bucket is as deep as the directory is, as deep as the keys need.

Owner tasks have ranges of buckets each, and write them in order, so that a bucket lies in one file or two that follow
each other.  In a bucket, texts whose hashes collide are a chain.  Bytes are compared when the index is built: they are
part of the grouping key, so equal hashes of different texts never merge.  A row is then looked up by the directory, its
bucket and the chain, where digests (SHA-256, found equal for different bytes: an error) tell texts apart.  Copies meet in
map-side aggregates first, so that a group with a third of all rows sends one row per map task.

Null text counts as empty, and empty texts equal each other.  Of equal texts the one with the most code
points in its original form stays, then the smallest id, a null id last.  A repeated or null id gives a row for each of its rows; the
rows of that id count as kept where text and id are those of the row that stays.  An empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.llm.common import id_text, partitions, saved, squeezed

CAPACITY = 1 << 16


@dataclass(frozen=True)
class Directory:
    """``slots[i]`` is the bucket of the keys whose first ``depth`` bits are i; buckets are numbered in key order."""

    depth: int
    slots: tuple[int, ...]
    bucket_depths: tuple[int, ...]


def grow_directory(counts: dict[int, int], depth: int, capacity: int) -> Directory:
    """Split overfull buckets, from one bucket of depth 0; ``counts`` has the keys of each slot at ``depth``."""
    levels = [counts]
    for _ in range(depth):
        above: dict[int, int] = {}
        for slot, n in levels[-1].items():
            above[slot >> 1] = above.get(slot >> 1, 0) + n
        levels.append(above)
    levels.reverse()
    full, done = [(0, 0)], []
    while full:
        d, prefix = full.pop()
        if d < depth and levels[d].get(prefix, 0) > capacity:
            full += [(d + 1, 2 * prefix + 1), (d + 1, 2 * prefix)]
        else:
            done.append((d, prefix))
    deepest = max(d for d, _ in done)
    slots = [b for b, (d, _) in enumerate(done) for _ in range(1 << (deepest - d))]
    return Directory(deepest, tuple(slots), tuple(d for d, _ in done))


def _slot(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth).cast("int") if depth else F.lit(0)


def _big() -> Column:
    return F.lit(Decimal(10**20))


def _no_id() -> Column:
    """Behind all ids: above 2**63, below half of _big()."""
    return F.lit(Decimal(10**19))


def _order(n_cp: Column, doc_id: Column) -> Column:
    """Larger for more code points, then for smaller ids, null last; a decimal, so that hash aggregates can hold it."""
    return (n_cp.cast("decimal(17,0)") * _big() - F.coalesce(doc_id.cast("decimal(20,0)"), _no_id())).cast("decimal(38,0)")


def _counted(hashes: DataFrame, capacity: int) -> tuple[dict[int, int], int]:
    """The distinct hashes of each slot, at a depth at which no slot has more than ``capacity``: a few slots for each bucket."""
    depth = max(1, (hashes.count() // capacity).bit_length() + 2)
    while True:
        counts = {r["slot"]: r["count"] for r in hashes.groupBy(_slot(F.col("hash"), depth).alias("slot")).count().collect()}
        if max(counts.values(), default=0) <= capacity or depth >= 32:
            return counts, depth
        depth += 2


def bucket_of(h: Column, directory: Directory) -> Column:
    """Look a hash up in the directory, which goes to the tasks as one string."""
    if not directory.depth:
        return F.lit(0)
    slots = F.split(F.lit(",".join(map(str, directory.slots))), ",").cast("array<int>")  # folded to an array once
    return F.get(slots, _slot(h, directory.depth))


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64) -> tuple[DataFrame, DataFrame, Directory]:
    """The keys of all rows, the index of all distinct texts, both in the shared folder, and the directory.

    keys: doc_id, n_cp, hash, sha (binary).  index: bucket, hash, and chain, an array of the hash's texts (their digest,
    best row and number of rows) in the digest's order; its files hold ranges of buckets, each in order.  ``hash_bits``
    below 64 makes hashes collide, for tests.
    """
    text = id_text(docs, id_col, text_col).select("doc_id", F.length("text").cast("long").alias("n_cp"), squeezed(F.col("text")).alias("norm"))
    h = F.xxhash64("norm")
    text = text.withColumn("hash", h if hash_bits == 64 else F.shiftleft(h, 64 - hash_bits))
    keys = saved(text.select("doc_id", "n_cp", "hash", F.unhex(F.sha2("norm", 256)).alias("sha")), "keys")
    counts, depth = _counted(keys.select("hash").distinct(), capacity)
    directory = grow_directory(counts, depth, capacity)

    best = F.max(_order(F.col("n_cp"), F.col("doc_id"))).alias("best")
    entries = text.groupBy("hash", "norm").agg(best, F.count("*").alias("group_size"))
    entries = entries.select(bucket_of(F.col("hash"), directory).alias("bucket"), "hash", F.struct(F.unhex(F.sha2("norm", 256)).alias("sha"), "best", "group_size").alias("entry"))
    owned = entries.repartitionByRange(partitions(docs.sparkSession), "bucket", "hash")
    index = owned.groupBy("bucket", "hash").agg(F.sort_array(F.collect_list("entry")).alias("chain"))  # the texts of one hash: hardly ever two
    twice = F.size(F.array_distinct(F.transform("chain", lambda e: e["sha"]))) < F.size("chain")  # different bytes, one digest: never yet seen
    index = index.withColumn("chain", F.when(twice, F.raise_error(F.lit("two texts have one SHA-256"))).otherwise(F.col("chain")))
    return keys, saved(index.sortWithinPartitions("bucket", "hash"), "index"), directory


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain (from 1)."""
    return probe(*build_index(docs, id_col=id_col, text_col=text_col, capacity=capacity, hash_bits=hash_bits))


def probe(keys: DataFrame, index: DataFrame, directory: Directory) -> DataFrame:
    """Look rows up: the directory has the bucket of a hash, the bucket its chain, which is walked for the row's digest."""
    found = keys.withColumn("bucket", bucket_of(F.col("hash"), directory)).join(index, ["bucket", "hash"])
    place = F.array_position(F.transform("chain", lambda e: e["sha"]), F.col("sha")).cast("int")
    found = found.select("doc_id", "n_cp", "sha", "bucket", place.alias("chain"), F.get("chain", place - 1).alias("e")).select("*", "e.best", "e.group_size")
    # best = n_cp * 10**20 - id with |id| <= 10**19, so n_cp is the nearest multiple.
    n = F.round(F.col("best") / _big()).cast("decimal(17,0)")
    keep = n * _big() - F.col("best")
    return found.select(
        "doc_id",
        F.when(keep < _no_id(), keep).cast("long").alias("keep_id"),
        "group_size",
        (_order(F.col("n_cp"), F.col("doc_id")) == F.col("best")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "chain",
    )


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; where that very row is repeated, once."""
    stay = exact_dedup(docs, id_col=id_col, text_col=text_col).where("kept")
    stay = stay.select(F.col("doc_id").alias("__stay"), F.col("text_sha256").alias("__text")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({"__id": F.col(id_col).cast("long"), "__sha": F.sha2(squeezed(text), 256)})
    same = W.partitionBy("__id", "__sha").orderBy(F.length(text).desc(), F.xxhash64(text_col))
    # One row of each id and text before the join, so that nothing but ids is compared in it.
    rows = rows.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")
    return rows.join(stay, F.col("__id").eqNullSafe(F.col("__stay")) & (F.col("__sha") == F.col("__text")), "left_semi").select(*docs.columns)
