"""Exact top-k by inner product, with KD-trees.

Vectors become integers, floor(scale * x).  A KD-tree over a bounded sample cuts space into cells; a shard is a cell's
vectors, or where a cell has more than a shard takes (many copies of one vector), a part of them by a hash of the id.
Each shard holds a KD-tree: median splits along the widest side, a tight bounding box for every node.  For a query, no
vector of a box has a larger inner product than the sum over its components of the larger product with the box's two
sides; nodes are visited in the order of that bound, until the bound is below the k-th score found.  Each query searches
the shard whose box has the greatest bound first; its k-th score there then leaves out all shards whose boxes have a
bound below, and goes with it to the others.  Equal scores go to smaller ids, so what is passed over has a bound less
than, not equal to, the k-th score.

The sample only places the cuts: every vector is in a shard, and boxes are those of all its vectors.  Boxes go to all
tasks; there are at most ``MOST_SHARDS`` cells and as many shards again.

Vectors that are null, or have a null, infinite or NaN component, take no part, nor do those of which scale * x is beyond
the range of doubles.  Scores are exact at any size; those beyond the range of a 64-bit integer count as its end.
Shorter vectors count as padded with zeros.  A row whose id is the query's isn't its candidate; other repeated rows are
candidates each.  A query whose id is repeated is answered for each of its different vectors.  Fewer candidates than k:
all of them.  An empty table, or no query: no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.llm.common import saved, tune

SHARD_ROWS, BLOCK_ROWS, LEAF = 16_384, 2_048, 64
#: Shards grow beyond SHARD_ROWS rather than be more than this; rows of the sample for each.
MOST_SHARDS, SAMPLE_ROWS = 4_096, 16
EXACT, FURTHEST = 2.0**53, 2**63 - 1


class Tree:
    """Nodes in order of creation; a leaf has rows start to stop of ids and vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        low, high, child, span = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(low)
            if parent >= 0:
                child[parent][side] = me
            v = vectors[order[a:b]]
            low.append(v.min(axis=0))
            high.append(v.max(axis=0))
            child.append([-1, -1])
            span.append((a, b))
            wide = int((high[-1].astype(float) - low[-1]).argmax())
            if b - a > leaf and high[-1][wide] > low[-1][wide]:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(v[:, wide], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.low, self.high, self.child, self.span = np.array(low), np.array(high), child, span
        self.ids, self.vectors = ids[order], vectors[order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Of every node (columns) for every query (rows); exact, as products of small integers in doubles are."""
        return _clipped(np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T)

    def search(self, query_id: int, q: np.ndarray, bound: np.ndarray, k: int, kth: float) -> list[tuple[float, int]]:
        """The best (score, -id) of at most k rows, none below kth, by best-first traversal."""
        best: list[tuple[float, int]] = []
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < kth:
                break
            left, right = self.child[node]
            if left >= 0:
                for c in (left, right):
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            start, stop = self.span[node]
            scores = _clipped(self.vectors[start:stop] @ q)
            for i in np.flatnonzero(scores >= kth):
                if self.ids[start + i] == query_id:
                    continue
                row = (scores[i], -int(self.ids[start + i]))
                if len(best) < k:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return best


def _clipped(scores: np.ndarray) -> np.ndarray:
    """Python's integers to the range of 64 bits; doubles here are integers below 2**53."""
    return np.minimum(np.maximum(scores, -FURTHEST - 1), FURTHEST) if scores.dtype == object else scores


def _exact(v: np.ndarray, q: np.ndarray) -> bool:
    return not len(v) or not len(q) or float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1] < EXACT


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Cells:
    """Median splits along the widest side of a sample, into about ``n`` cells."""

    def __init__(self, sample: np.ndarray, n: int):
        self.nodes: list[tuple] = []  # (side, cut, node of the smaller, node of the others), or (cell,)
        self.count, todo = 0, [(sample, n, -1, 0)]
        while todo:
            part, cells, parent, place = todo.pop()
            if parent >= 0:
                self.nodes[parent] = self.nodes[parent][:place] + (len(self.nodes),) + self.nodes[parent][place + 1 :]
            side = int((part.max(axis=0) - part.min(axis=0)).argmax()) if len(part) > 1 else 0
            cut = float(np.median(part[:, side])) if len(part) > 1 else 0.0
            below = part[:, side] < cut if len(part) > 1 else np.zeros(len(part), bool)
            if cells > 1 and below.any():
                me = len(self.nodes)
                self.nodes.append((side, cut, -1, -1))
                todo += [(part[below], cells // 2, me, 2), (part[~below], cells - cells // 2, me, 3)]
            else:
                self.nodes.append((self.count,))
                self.count += 1

    def of(self, vectors: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(vectors), np.int32), [(0, np.arange(len(vectors)))]
        while todo:
            node, at = todo.pop()
            if len(at) and len(n := self.nodes[node]) == 1:
                out[at] = n[0]
            elif len(at):
                below = vectors[at, n[0]] < n[1]
                todo += [(n[2], at[below]), (n[3], at[~below])]
        return out


def _floor(x: Column) -> Column:
    """As a double: what F.floor gives is a long, which ends at 2**63; from 2**53 on doubles are integers anyway."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def integers(vectors: DataFrame, *, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double, all integers): the vectors that take part."""
    whole = F.transform(F.col(vector_col), lambda c: _floor(c.cast("double") * scale))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")).where("v IS NOT NULL").where(finite)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    tune(spark)
    whole = integers(vectors, scale=scale, id_col=id_col, vector_col=vector_col)
    size = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.sum(is_query.cast("int")).alias("q")).first()
    rows = max(shard_rows, -(-size["n"] // MOST_SHARDS))
    wanted, n_blocks, width = max(1, -(-size["n"] // rows)), max(1, -(-(size["q"] or 0) // block_rows)), size["width"] or 0

    sample = whole.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE_ROWS * wanted).select("v").collect() if wanted > 1 else []
    cells = spark.sparkContext.broadcast(Cells(_matrix([r["v"] for r in sample], width), wanted))

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(cells.value.of(_matrix(list(v), width)))

    placed = whole.withColumn("cell", cell("v"))
    full = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most MOST_SHARDS
    parts = [-(-full.get(c, 0) // rows) for c in range(cells.value.count)]
    first, of = F.lit(",".join(map(str, np.cumsum([0, *parts])))), F.lit(",".join(str(max(1, p)) for p in parts))
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.get(F.split(of, ",").cast("array<int>"), "cell"))
    shards = placed.withColumn("shard", (F.get(F.split(first, ",").cast("array<int>"), "cell") + part).cast("int"))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf["vec_id"].to_numpy(), _matrix(list(pdf["v"]), width))
        return pd.DataFrame({"shard": [int(key[0])], "tree": [pickle.dumps(tree)], "low": [tree.low[0]], "high": [tree.high[0]]})

    trees = saved(shards.select("vec_id", "v", "shard").groupBy("shard").applyInPandas(grow, "shard int, tree binary, low array<double>, high array<double>"), "trees")
    found = sorted((r["shard"], r["low"], r["high"]) for r in trees.select("shard", "low", "high").collect())  # at most 2 * MOST_SHARDS
    boxes = spark.sparkContext.broadcast(tuple(np.array([f[i] for f in found], float if i else int).reshape(len(found), -1 if found else 1) for i in range(3)))

    def ask(first_only: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, low, high = boxes.value
            for pdf in frames:
                out = []
                with np.errstate(all="ignore"):
                    q = _matrix(list(pdf["v"]), width)
                    up, down = np.maximum(q, 0), np.minimum(q, 0)
                    bound = up @ high.T + down @ low.T
                    slack = 1e-12 * (up @ np.abs(high).T - down @ np.abs(low).T)  # more than doubles can be off
                home = np.nan_to_num(bound, nan=np.inf).argmax(axis=1) if len(pdf) else []
                for i, h in enumerate(home):
                    if first_only:
                        chosen = [h]
                    else:
                        kth = pdf["kth"].iloc[i]
                        chosen = np.flatnonzero(~(bound[i] + slack[i] < (-np.inf if pd.isna(kth) else kth)))
                        chosen = chosen[chosen != h]
                    out.append(pd.DataFrame({"shard": ids[chosen, 0].astype(np.int32)}).assign(vec_id=pdf["vec_id"].iloc[i], q_key=pdf["q_key"].iloc[i]))
                yield pd.concat(out)[["vec_id", "q_key", "shard"]] if out else pd.DataFrame({"vec_id": [], "q_key": [], "shard": []})

        return run

    def visit(pdf_q: pd.DataFrame, pdf_t: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf_q) and len(pdf_t):
            tree = pickle.loads(pdf_t["tree"].iloc[0])
            q = _matrix(list(pdf_q["v"]), width)
            if not _exact(tree.vectors, q):  # Python's integers where doubles would round
                whole_ = np.frompyfunc(int, 1, 1)
                for a in ("vectors", "low", "high"):
                    setattr(tree, a, whole_(getattr(tree, a)))
                q = whole_(q)
            for i, bound in enumerate(tree.bounds(q)):
                kth = pdf_q["kth"].iloc[i]
                hits = tree.search(int(pdf_q["vec_id"].iloc[i]), q[i], bound, k, -np.inf if pd.isna(kth) else int(kth))
                out += [(pdf_q["vec_id"].iloc[i], pdf_q["q_key"].iloc[i], -j, int(s)) for s, j in hits]
        return pd.DataFrame(out, columns=["query_id", "q_key", "vec_id", "score"])

    block = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(2)), F.lit(n_blocks)).cast("int")
    queries = whole.where(is_query).distinct().withColumns({"block": block, "q_key": F.xxhash64("v")})

    def searched(queries: DataFrame, first_only: bool) -> DataFrame:
        """By shard and block of queries; a tree goes to the blocks that ask for it."""
        to = queries.select("vec_id", "q_key", "v", "kth").mapInPandas(ask(first_only), "vec_id long, q_key long, shard int")
        asked = queries.join(to, ["vec_id", "q_key"])
        asked = saved(asked.select("vec_id", "v", "q_key", "kth", "block", "shard"), "asked")
        pairs = asked.select(F.col("shard").alias("to_shard"), F.col("block").alias("to_block")).distinct()
        needed = trees.select(F.col("shard").alias("to_shard"), "tree").join(pairs, "to_shard")
        return asked.groupBy("shard", "block").cogroup(needed.groupBy("to_shard", "to_block")).applyInPandas(visit, "query_id long, q_key long, vec_id long, score long")

    at_home = saved(searched(queries.withColumn("kth", F.lit(None).cast("long")), True), "first")
    kth = at_home.groupBy("query_id", "q_key").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    others = queries.join(kth.select(F.col("query_id").alias("vec_id"), "q_key", "kth"), ["vec_id", "q_key"], "left")
    every = at_home.unionByName(searched(others, False)) if len(found) > 1 else at_home
    order = W.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
