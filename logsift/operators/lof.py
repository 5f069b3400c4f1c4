"""Local outlier factor (OD4), k = 20, euclidean -- exact, without all pairs.

k-nearest neighbours are found with a space partition instead of a cross join:

1. identical points are collapsed to (point, multiplicity): a value repeated
   a billion times is one row;
2. a k-d tree is built on the driver from a bounded hash sample of the
   distinct points; its leaves (boxes) hold about ``leaf_size`` points each;
   points are routed to leaves in ``mapInPandas`` (narrow); neighbouring leaves
   form a strip of bounded size, more strips than cores where there are leaves;
3. per strip (``applyInArrow``) every point gets its k nearest samples inside
   the strip and a tentative radius r;
4. a strip asks the leaves outside it whose boxes meet the ball B(p, r) of one
   of its points; those leaves' points stream past it, and each is compared with
   the points whose ball, which shrinks meanwhile, meets its leaf's box;
5. a matrix product rules out most pairs, with room for its rounding; the
   distances of the others are computed as they always were, and the k nearest
   (distance, point) are kept;
6. k-distance, reachability, local reachability density and the factor are
   joins and aggregates.  score = -LOF (lower = more anomalous).

Exact: a neighbour outside every asked box is farther than r.  A task holds one
strip and one batch of other points.  What is shuffled is each leaf once for each
strip that asks it, which stays near the input in low dimensions (window
metadata).  In many dimensions without clusters every strip asks every leaf: the
exact work is all pairs there, a multiplication for each pair and dimension.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.session import ship_package, staged

EPS = 1e-10
#: What a strip's points and their neighbours take, about.
STRIP_BYTES = 16 << 20


@dataclass
class KdTree:
    split_dim: np.ndarray
    split_val: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf_of_node: np.ndarray       # leaf id for leaf nodes, -1 otherwise
    box_lo: np.ndarray             # (n_leaves, d)
    box_hi: np.ndarray


def build_kdtree(sample: np.ndarray, leaf_sample: int) -> KdTree:
    d = sample.shape[1]
    sd, sv, lf, rt, leaf = [], [], [], [], []
    lo_boxes, hi_boxes = [], []

    def node(ix, lo, hi):
        me = len(sd)
        sd.append(-1), sv.append(0.0), lf.append(-1), rt.append(-1), leaf.append(-1)
        pts = sample[ix]
        spread = pts.max(axis=0) - pts.min(axis=0) if len(ix) else np.zeros(d)
        if len(ix) <= leaf_sample or spread.max() <= 0:
            leaf[me] = len(lo_boxes)
            lo_boxes.append(lo.copy()), hi_boxes.append(hi.copy())
            return me
        dim = int(np.argmax(spread))
        val = float(np.median(pts[:, dim]))
        go_left = pts[:, dim] < val
        if go_left.all() or not go_left.any():      # median equals the max: split below it
            val = float(np.max(pts[:, dim]))
            go_left = pts[:, dim] < val
        sd[me], sv[me] = dim, val
        llo, lhi, rlo, rhi = lo.copy(), hi.copy(), lo.copy(), hi.copy()
        lhi[dim], rlo[dim] = val, val
        lf[me] = node(ix[go_left], llo, lhi)
        rt[me] = node(ix[~go_left], rlo, rhi)
        return me

    node(np.arange(len(sample)), np.full(d, -np.inf), np.full(d, np.inf))
    return KdTree(np.array(sd), np.array(sv), np.array(lf), np.array(rt), np.array(leaf),
                  np.array(lo_boxes), np.array(hi_boxes))


def route(tree: KdTree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    active = tree.split_dim[node] >= 0
    while active.any():
        r = np.flatnonzero(active)
        nd = node[r]
        go_left = x[r, tree.split_dim[nd]] < tree.split_val[nd]
        node[r] = np.where(go_left, tree.left[nd], tree.right[nd])
        active = tree.split_dim[node] >= 0
    return tree.leaf_of_node[node]


def _box_dist(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Distance from each point (n, d) to each box (L, d) -> (n, L)."""
    gap = np.maximum(lo[None, :, :] - x[:, None, :], 0) + np.maximum(x[:, None, :] - hi[None, :, :], 0)
    return np.sqrt((gap ** 2).sum(axis=2))


class _Nearest:
    """The k nearest samples (with multiplicity) of some points, as batches of other points come by."""

    def __init__(self, pid, x, k, kept=None):
        self.pid, self.x, self.k = pid, x, k
        self.centre = x.mean(axis=0)
        self.a = x - self.centre
        self.a2 = (self.a ** 2).sum(axis=1)
        self.kept = kept or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        self.new, self.waiting = [], 0
        self.settle()

    def settle(self):
        """Keep the k nearest of what was kept and what came since; the k-th is the radius."""
        q, o, d, w = (np.concatenate(c) for c in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((o, d, q))
        q, o, d, w = q[order], o[order], d[order], w[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        before = np.cumsum(w) - w
        before -= np.repeat(before[first], np.diff(first, append=len(q)))
        w = np.minimum(w, self.k - before)
        self.kept = q, o, d, w = tuple(c[w > 0] for c in (q, o, d, w))
        self.new, self.waiting = [], 0
        self.r = np.full(len(self.pid), np.inf)
        last = np.flatnonzero(np.diff(q, append=-1))
        full = np.bincount(q, w, len(self.pid))[q[last]] >= self.k
        self.r[q[last[full]]] = d[last[full]]

    def add(self, rows, pid, x, m):
        """Compare the points number ``rows`` with a batch of points; a point's own copies count m - 1 at distance 0."""
        if not len(rows) or not len(x):
            return
        n, dim = x.shape
        b = x - self.centre
        b2 = (b ** 2).sum(axis=1)
        others = {}
        step = max(1, (1 << 20) // n)
        for s in range(0, len(rows), step):
            at = rows[s:s + step]
            r2 = self.r[at] ** 2
            reach = (np.sqrt(self.a2[at].max()) + np.sqrt(b2.max())) ** 2
            slack = lambda kind: 4 * (dim + 8) * float(np.finfo(kind).eps) * reach
            kind = np.float32 if reach < 1e30 and slack(np.float32) <= 0.01 * np.median(r2) else np.float64
            if kind not in others:
                others[kind] = np.column_stack([b, np.ones(n), b2]).astype(kind)
            lim = np.minimum(r2, 1e30 if kind == np.float32 else 1e300)
            mine = np.column_stack([-2 * self.a[at], self.a2[at] - lim - slack(kind), np.ones(len(at))]).astype(kind)
            near = np.flatnonzero(~((mine @ others[kind].T).ravel() > 0))  # squared distance less squared radius
            for t in range(0, len(near), 1 << 16):
                q, o = np.divmod(near[t:t + (1 << 16)], n)
                q = at[q]
                dist = np.sqrt(((self.x[q] - x[o]) ** 2).sum(axis=1))
                w = m[o] - (pid[o] == self.pid[q])
                keep = (w > 0) & (dist <= self.r[q])
                self.new.append((q[keep], pid[o[keep]], dist[keep], w[keep]))
                self.waiting += int(keep.sum())
            if self.waiting > max(1 << 17, len(self.kept[0]) // 2):
                self.settle()


def _meets(x, r, lo, hi):
    """Numbers of the points whose ball of radius ``r`` meets the box."""
    return np.flatnonzero(_box_dist(x, lo[None, :], hi[None, :])[:, 0] <= r)


def _points(table, d):
    """(leaf, pid, m, x) of an Arrow table or batch."""
    leaf, pid, m = (table.column(c).to_numpy() for c in ("_leaf", "_pid", "_m"))
    return leaf, pid, m, np.frombuffer(b"".join(table.column("_x").to_pylist()), "<f8").reshape(-1, d)


def _strip_neighbours(leaf, pid, m, x, k, lo, hi):
    """The k nearest inside the strip, first in a point's own leaf, then in the leaves that its ball meets."""
    own = [(leaf_id, np.flatnonzero(leaf == leaf_id)) for leaf_id in np.unique(leaf)]
    kept = []
    for _, rows in own:
        some, s, size = _Nearest(pid[rows], x[rows], k), 0, 64
        while s < len(rows):  # a few points give a first radius
            part = rows[s:s + size]
            some.add(np.arange(len(rows)), pid[part], x[part], m[part])
            some.settle()
            s, size = s + size, 4 * size
        kept.append((rows[some.kept[0]], *some.kept[1:]))
    near = _Nearest(pid, x, k, tuple(np.concatenate(c) for c in zip(*kept, strict=True)))
    for leaf_id, rows in own:
        asks = _meets(x, near.r, lo[leaf_id], hi[leaf_id])
        near.add(asks[leaf[asks] != leaf_id], pid[rows], x[rows], m[rows])
    near.settle()
    return near


def _asked(leaf, x, r, lo, hi):
    """Leaves outside the strip whose box meets the ball of one of its points."""
    inside, out = set(leaf.tolist()), []
    low, high, far = x.min(axis=0), x.max(axis=0), r.max()
    gap = np.maximum(lo - high, 0) + np.maximum(low - hi, 0)
    for box in np.flatnonzero(np.sqrt((gap ** 2).sum(axis=1)) <= far).tolist():
        if box not in inside and any(len(_meets(x[s:s + 1024], r[s:s + 1024], lo[box], hi[box])) for s in range(0, len(x), 1024)):
            out.append(box)
    return out


@dataclass
class LofModel:
    offset: float | None
    k: int


def local_outlier_factor(df: DataFrame, key: str, cols: list[str], n_neighbors: int = 20,
                         contamination: float | None = 0.1, leaf_size: int = 2048,
                         sample_size: int = 200_000, seed: int = 42):
    """Returns (rows with ``lof`` and ``anomaly_score`` = -lof, LofModel).

    ``df``: one row per item with numeric ``cols`` (low dimension); a null or NaN
    feature is an error."""
    from logsift.llm.common import even_keys
    from logsift.operators.order import quantile_exact

    spark = df.sparkSession
    ship_package(spark)
    d = len(cols)
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    if df.filter(bad).limit(1).count():
        raise ValueError("features hold null or NaN")
    pts = (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
           .groupBy(*cols).agg(F.count(F.lit(1)).alias("_m")))
    # written tables cut the lineage: each step reads the one before several times
    pts = staged(pts.withColumn("_pid", F.xxhash64(*cols, F.lit(seed))), "lof-points")
    stats = pts.agg(F.count(F.lit(1)).alias("nd"), F.sum("_m").alias("n")).first()
    n_distinct, n = stats["nd"], stats["n"]
    if not n:
        raise ValueError("no rows")
    k = min(n_neighbors, n - 1)
    if k < 1:
        raise ValueError("need at least two rows")
    # pids must be unique per distinct point (checked, not assumed)
    if pts.select("_pid").distinct().count() != n_distinct:
        raise ValueError("point id collision; perturb the seed")
    rate = min(1.0, sample_size / n_distinct)
    u = F.pmod(F.xxhash64("_pid", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    drawn = pts.filter(u < rate).select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]).toArrow()
    sample = np.column_stack([c.to_numpy() for c in drawn.columns]).astype(float).reshape(-1, d)
    leaf_sample = max(1, int(leaf_size * len(sample) / max(1, n_distinct)))
    tree = build_kdtree(sample, leaf_sample)
    lo, hi = tree.box_lo, tree.box_hi
    # a strip's points with their neighbours take some 16 MB; each strip has a partition of its own
    size = n_distinct * (8 * d + 24 * k)
    strips = min(len(lo), max(3 * spark.sparkContext.defaultParallelism, -(-size // STRIP_BYTES)))
    strip_of = np.array(even_keys(spark, strips))[np.arange(len(lo)) * strips // len(lo)]

    def assign(batches):
        for pdf in batches:
            x = np.ascontiguousarray(pdf[cols].to_numpy(dtype="<f8"))
            leaf = route(tree, x)
            yield pd.DataFrame({"_strip": strip_of[leaf], "_leaf": leaf, "_pid": pdf["_pid"], "_m": pdf["_m"],
                                "_x": [row.tobytes() for row in x]})

    point = "_strip long, _leaf long, _pid long, _m long, _x binary"
    placed = staged(pts.mapInPandas(assign, point), "lof-leaves")

    def inside(points):
        import pyarrow as pa

        leaf, pid, m, x = _points(points, d)
        near = _strip_neighbours(leaf, pid, m, x, k, lo, hi)
        q, o, dist, w = near.kept
        at = pa.array(np.searchsorted(q, np.arange(len(pid) + 1)).astype(np.int32))
        asks = [_asked(leaf, x, near.r, lo, hi), *[[]] * (len(pid) - 1)]  # with the strip's first point
        more = {"_asks": pa.array(asks, pa.list_(pa.int64()))} | {
            c: pa.ListArray.from_arrays(at, pa.array(v)) for c, v in (("_o", o), ("_d", dist), ("_w", w))}
        return pa.table({c: points.column(c) for c in ("_strip", "_leaf", "_pid", "_m", "_x")} | more)

    lists = ", _asks array<long>, _o array<long>, _d array<double>, _w array<long>"
    known = staged(placed.repartition(strips, "_strip").groupBy("_strip").applyInArrow(inside, point + lists), "lof-strips")
    asks = known.select("_strip", F.explode("_asks").alias("_leaf"))
    sent = placed.drop("_strip").join(asks, "_leaf")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("_o", "array<long>"), ("_d", "array<double>"), ("_w", "array<long>"))]
    stream = (known.select("_strip", F.lit(0).alias("_kind"), "_leaf", "_pid", "_m", "_x", "_o", "_d", "_w")
              .unionByName(sent.select("_strip", F.lit(1).alias("_kind"), "_leaf", "_pid", "_m", "_x", *none))
              .repartition(strips, "_strip").sortWithinPartitions("_strip", "_kind", "_leaf"))

    def outside(batches):
        import pyarrow as pa

        def start(parts):
            t = pa.Table.from_batches(parts)
            _, pid, _, x = _points(t, d)
            o, dist, w = (t.column(c).combine_chunks() for c in ("_o", "_d", "_w"))
            q = np.repeat(np.arange(len(pid)), o.value_lengths().to_numpy(zero_copy_only=False))
            return _Nearest(pid, x, k, (q, *(c.flatten().to_numpy(zero_copy_only=False) for c in (o, dist, w))))

        def done(near):
            near.settle()
            q, o, dist, w = near.kept
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (near.pid[q], o, dist, w)], ["_q", "_o", "_d", "_w"])

        strip, parts, near = None, [], None
        for batch in batches:
            kind, strip_at, leaf_at = (batch.column(c).to_numpy().astype(np.int64) for c in ("_kind", "_strip", "_leaf"))
            change = np.flatnonzero((np.diff(strip_at, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)
                                    | ((np.diff(leaf_at, prepend=-1) != 0) & (kind == 1)))
            if len(batch) and (not len(change) or change[0] != 0):
                change = np.concatenate([[0], change])
            for s, e in zip(change, [*change[1:], len(kind)], strict=True):
                part = batch.slice(s, e - s)
                if strip_at[s] != strip:
                    if parts or near:
                        yield done(near or start(parts))
                    strip, parts, near = strip_at[s], [], None
                if kind[s] == 0:
                    parts.append(part)
                    continue
                if near is None:
                    near, parts = start(parts), []
                leaf, pid, m, x = _points(part, d)
                near.add(_meets(near.x, near.r, lo[leaf[0]], hi[leaf[0]]), pid, x, m)
        if parts or near:
            yield done(near or start(parts))

    nb = staged(stream.mapInArrow(outside, "_q long, _o long, _d double, _w long"), "lof-neighbours")
    kdist = nb.groupBy("_q").agg(F.max("_d").alias("_kd"))
    reach = (nb.join(kdist.withColumnRenamed("_q", "_o").withColumnRenamed("_kd", "_okd"), "_o")
             .withColumn("_reach", F.greatest(F.col("_okd"), F.col("_d"))))
    lrd = reach.groupBy("_q").agg(
        (1.0 / (F.sum(F.col("_w") * F.col("_reach")) / F.lit(k) + F.lit(EPS))).alias("_lrd"))
    lof = (nb.join(lrd.withColumnRenamed("_q", "_o").withColumnRenamed("_lrd", "_olrd"), "_o")
           .groupBy("_q").agg((F.sum(F.col("_w") * F.col("_olrd")) / F.lit(k)).alias("_sum"))
           .join(lrd, "_q")
           .select(F.col("_q").alias("_pid"), (F.col("_sum") / F.col("_lrd")).alias("lof")))
    per_point = pts.join(lof, "_pid").select(*cols, "lof")
    rows = df.select(*[c for c in df.columns if c not in cols],
                     *[F.col(c).cast("double").alias(c) for c in cols])
    out = staged(rows.join(per_point, cols).withColumn("anomaly_score", -F.col("lof")), "lof-scores")
    offset = quantile_exact(out, "anomaly_score", contamination) if contamination else None
    return out, LofModel(offset, k)
