"""Exact top-k search by MaxScore over signed postings, shard by shard.

A vector's components are its terms' impacts.  Term (d, +) has a posting for every row with a positive
component d, term (d, -) for every row with a negative one; a query asks for the term of its own sign,
whose postings can only raise a score.  A term's bound is the query's weight times the highest impact
among a chunk's postings.

Per chunk of a shard, the terms in ascending order of bound are non-essential as long as their bounds sum
to less than the k-th score found so far: a row found in these lists only can't reach it.  The postings
of the essential terms are traversed, which gives the rows to score; the other dimensions are probed
in falling order of bound, and a row is dropped as soon as its score and the bounds left stay below the
k-th score.  Ties stay in, so equal scores go to the smaller id.  Shards' heaps merge at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_cells import Grid, best, integer_rows, matrix

CHUNK, PROBE = 2048, 4


class Chunk:
    """Postings and impacts of some rows: who holds a term, and by how much at most."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.impacts = ids, np.ascontiguousarray(vectors.T)
        self.held = {1: self.impacts > 0, -1: self.impacts < 0}
        self.most = {1: np.maximum(self.impacts.max(1), 0), -1: np.maximum(-self.impacts.min(1), 0)}

    def search(self, query: np.ndarray, own: int, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The heap (scores, ids) with this chunk's rows, and the number of (row, dimension) products it took."""
        sign = np.where(query > 0, 1, -1)
        bounds = np.abs(query) * np.where(sign > 0, self.most[1], self.most[-1])
        order = np.argsort(bounds, kind="stable")
        least = scores[-1] if len(scores) == k else None
        if least is None or least <= 0:  # a row without any posting may still belong
            n_rest, rows = 0, np.flatnonzero(self.ids != own)
        else:
            n_rest = int(np.searchsorted(np.cumsum(bounds[order]), least))  # sums strictly below the k-th score
            hit = np.zeros(len(self.ids), bool)
            for d in order[n_rest:]:
                hit |= self.held[int(sign[d])][d]
            rows = np.flatnonzero(hit & (self.ids != own))
        essential, rest = order[n_rest:], order[:n_rest][::-1]
        total = query[essential] @ self.impacts[np.ix_(essential, rows)]
        work = len(essential) * len(rows)
        left = bounds[rest].sum()
        for at in range(0, len(rest), PROBE):
            near = total + left >= least
            rows, total = rows[near], total[near]
            if not len(rows):
                break
            dims = rest[at:at + PROBE]
            total = total + query[dims] @ self.impacts[np.ix_(dims, rows)]
            left -= bounds[dims].sum()
            work += len(dims) * len(rows)
        if least is not None:
            rows, total = rows[total >= least], total[total >= least]
        scores, ids = np.concatenate([scores, total]), np.concatenate([ids, self.ids[rows]])
        at = best(scores, ids, k)
        return scores[at], ids[at], work


def _search(k: int, dim: int):
    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        names, queries = left["id"].to_numpy(), matrix(left["vec"], dim)
        ids, rows = right["id"].to_numpy(), matrix(right["vec"], dim)
        heaps = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(names)
        for at in range(0, len(ids), CHUNK):
            chunk = Chunk(ids[at:at + CHUNK], rows[at:at + CHUNK])
            for q, own in enumerate(names):
                heaps[q] = chunk.search(queries[q], own, *heaps[q], k)[:2]
        return pa.table({"query_id": np.repeat(names, [len(s) for s, _ in heaps]), "score": np.concatenate([s for s, _ in heaps]),
                         "vec_id": np.concatenate([i for _, i in heaps])})

    return step


def top_k(df: DataFrame, queries: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` rows of the highest inner product, rank from 1.

    ``queries``: a condition on the column ``id``.  Components become floor(scale * x).  Ties go to the smaller
    id.  A null id or vector, or a null or non-finite component, takes a row out.  Vectors may differ in length (a
    shorter one ends in zeros) and be empty (all scores 0).  Rows that carry the query's id aren't
    candidates of it; apart from that, rows that repeat an id each count, and a query id that repeats is one
    query, the least vector.  Other columns are ignored; an empty table gives no rows.  Scores are exact
    while they and the sums of bounds fit 64 bits."""
    grid = Grid(integer_rows(df, scale, "search-rows", vec_id, vector), queries)
    found = grid.apply(grid.queries, _search(k, grid.dim), "query_id long, score long, vec_id long")
    top = grid.merge(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
