"""Hard-negative mining: Strassen products of anchor and candidate tiles, then mergeable heaps.

Scores are integer inner products.  A tile of anchors times a tile of candidates is one matrix product,
multiplied by Strassen's recursion: seven products of halves instead of eight, odd sides padded with a
row or column of zeros, sums and differences in 64-bit integers.  Arithmetic modulo 2^64 makes every
result exact that fits 64 bits, whatever the sums on the way.

The first run keeps a heap of the best same-label rows for each anchor, the second one a heap per
positive of the best different-label rows inside its score window.  Heaps of single cells merge over
all cells.  Rows lie in label order inside a cell, so each run skips tiles that hold none of its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vector_cells import Grid, best, integer_rows, matrix

#: A product with a side of at most LEAF is multiplied directly.
LEAF = 32
ANCHOR_TILE, ROW_TILE = 256, 2048


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2^64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * t), np.int64)
    out[:r, :t] = p1 + p4 - p5 + p7
    out[:r, t:] = p3 + p5
    out[r:, :t] = p2 + p4
    out[r:, t:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class _Side:
    """One side of a cell, in (label, id) order."""

    def __init__(self, t: pa.Table, dim: int):
        label, ids = t["label"].to_numpy(), t["id"].to_numpy()
        self.order = np.lexsort((ids, label))
        self.label, self.id = label[self.order], ids[self.order]
        self.vec = matrix(t["vec"], dim)[self.order]


def _tiles(anchors: _Side, rows: _Side, same: bool):
    """(first anchor, first row, scores) of each tile pair that can hold pairs with equal (or else different) labels."""
    for i in range(0, len(anchors.id), ANCHOR_TILE):
        of = anchors.label[i:i + ANCHOR_TILE]
        from_, to = (np.searchsorted(rows.label, of[0]), np.searchsorted(rows.label, of[-1], "right")) if same else (0, len(rows.id))
        for j in range(from_, to, ROW_TILE):
            end = min(j + ROW_TILE, to)
            if not same and of[0] == of[-1] == rows.label[j] == rows.label[end - 1]:
                continue
            yield i, j, strassen(anchors.vec[i:i + ANCHOR_TILE], rows.vec[j:end].T)


def _merged(held, scores, ids, k):
    """The ``k`` best of a heap, a pair of arrays or None, and more entries."""
    if held is not None:
        scores, ids = np.concatenate([held[0], scores]), np.concatenate([held[1], ids])
    at = best(scores, ids, k)
    return scores[at], ids[at]


def _positives(k: int, dim: int):
    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        a, c = _Side(left, dim), _Side(right, dim)
        heaps: dict = {}
        for i, j, scores in _tiles(a, c, True):
            end = j + scores.shape[1]
            for x, row in enumerate(scores, i):
                lo, hi = max(np.searchsorted(c.label, a.label[x]), j), min(np.searchsorted(c.label, a.label[x], "right"), end)
                if lo < hi:
                    other = c.id[lo:hi] != a.id[x]
                    heaps[x] = _merged(heaps.get(x), row[lo - j:hi - j][other], c.id[lo:hi][other], k)
        sizes = [len(h[0]) for h in heaps.values()]
        join = lambda n: np.concatenate([h[n] for h in heaps.values()]) if heaps else np.empty(0, np.int64)
        return pa.table({"anchor_id": np.repeat(a.id[list(heaps)], sizes) if heaps else np.empty(0, np.int64), "score": join(0), "id": join(1)})

    return step


def _negatives(k: int, low: int, dim: int):
    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        a, c = _Side(left, dim), _Side(right, dim)
        of = [[x["score"] for x in p] for p in left["positives"].to_pylist()]
        of = [of[x] for x in a.order]
        heaps: dict = {}
        for i, j, scores in _tiles(a, c, False):
            label, ids = c.label[j:j + scores.shape[1]], c.id[j:j + scores.shape[1]]
            for x, row in enumerate(scores, i):
                spans = [(-(-low * p // 100), p) for p in of[x]]  # the least score that a window holds, and the highest
                seen = np.flatnonzero((label != a.label[x]) & (ids != a.id[x]) & (row >= min(s[0] for s in spans)) & (row <= max(s[1] for s in spans)))
                if not len(seen):
                    continue
                seen = seen[np.lexsort((ids[seen], -row[seen]))]
                down = -row[seen]
                for p, (least, most) in enumerate(spans):
                    lo, hi = np.searchsorted(down, -most), np.searchsorted(down, -least, "right")
                    if lo < hi:
                        at = seen[lo:min(hi, lo + k)]
                        heaps[x, p] = _merged(heaps.get((x, p)), row[at], ids[at], k)
        rows = [(a.id[x], p, s, n) for (x, p), h in heaps.items() for s, n in zip(*h)]
        cols = list(zip(*rows)) or [[], [], [], []]
        return pa.table({"anchor_id": pa.array(cols[0], pa.int64()), "p": pa.array(cols[1], pa.int32()),
                         "negative_score": pa.array(cols[2], pa.int64()), "negative_id": pa.array(cols[3], pa.int64())})

    return step


def mine(df: DataFrame, label: Column, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256,
         vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1.

    An anchor (``anchors``: a condition on the column ``id``) has as positives its best ``positives`` rows of its
    label; each of those gets the best ``negatives`` rows of other labels whose score s fits
    low * positive <= 100 * s <= 100 * positive.  Ties go to the smaller id.

    ``label``: an integer class.  Null labels, ids or vectors and null or non-finite components take a row
    out.  Vectors may differ in length (a shorter one ends in zeros) and be empty (all scores 0).  Rows that carry the
    anchor's id aren't candidates of it; apart from that, rows that repeat an id each count, and an anchor id
    that repeats is one anchor, the least by (label, vector).  Other columns are ignored.  An anchor without
    positives, a positive without negatives and an empty table give no rows.  Scores are exact while they fit 64 bits."""
    rows = integer_rows(df, scale, "negatives-rows", vec_id, vector, label)
    grid = Grid(rows, anchors)
    first = grid.apply(grid.queries, _positives(positives, grid.dim), "anchor_id long, score long, id long")
    order = [F.col("score").desc(), F.col("id")]
    top = grid.merge(first, ["anchor_id"], order, positives).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    asked = stage(grid.queries.join(top.withColumnRenamed("anchor_id", "id"), "id"), "negatives-anchors")  # at most `positives` entries each
    second = grid.apply(asked, _negatives(negatives, low, grid.dim), "anchor_id long, p int, negative_score long, negative_id long")
    found = grid.merge(second, ["anchor_id", "p"], [F.col("negative_score").desc(), F.col("negative_id")], negatives)
    pairs = asked.select(F.col("id").alias("anchor_id"), F.posexplode("positives").alias("p", "positive"))
    return found.join(pairs, ["anchor_id", "p"]).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
        F.col("positive.score").alias("positive_score"), "negative_score")
