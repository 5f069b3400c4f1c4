"""Order slices: a skew-safe replacement for a global ``ORDER BY``.

Many operators need events in (timestamp, file order): the global position
for count windows (W1), and the event order inside a block or a time window
(T1).  A ``row_number()`` over an unpartitioned window, or one over a hot
block, runs in one task.  Instead the ordering key space is cut into
*slices* that hold a bounded number of rows and are themselves ordered:

* split points on the primary key (epoch microseconds) come from a
  deterministic hash sample (bounded size, like a range partitioner) and are
  pinned as literals, so recomputation after an executor loss gives the same
  slices;
* a key value holding more rows than one slice (many lines at one instant) is
  isolated in its own bucket and cut further by ``tie div rows_per_slice``
  (the tie column, a unique file-order index, bounds every piece);
* the bucket index is a binary search (``Bucketizer``), JVM-side and narrow.

Rows of one slice precede the rows of any later slice, so
``(bucket, sub)`` order plus an order inside the slice is the global order.
Exact counts per slice (one tiny aggregate) give each slice's offset.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

B, S = "_sb", "_ss"  # slice columns: bucket, sub-slice
MAX_SLICES = 200_000  # offsets table is broadcast: <= ~5 MB; beyond, slices grow instead
MIN_SLICES = 8  # small inputs are sliced too: one code path at every size
ROWS_PER_SLICE = 500_000
_MASK53 = (1 << 53) - 1


@dataclass
class SlicePlan:
    """Pinned split points of the key (as floats, exact below 2**53)."""
    splits: list[float]
    heavy_buckets: list[int] = field(default_factory=list)
    rows_per_slice: int = ROWS_PER_SLICE
    n_rows: int = 0
    tie_kind: str = "dense"  # "dense": unique row index; "hash": 64-bit hash of the row

    @property
    def n_buckets(self) -> int:
        return len(self.splits) - 1


def plan_slices(df: DataFrame, key: str, tie: str, rows_per_slice: int = ROWS_PER_SLICE,
                oversample: int = 8, seed: int = 17, n_rows: int | None = None,
                tie_kind: str = "dense") -> SlicePlan:
    """Build a slice plan for ``df`` ordered by (key, tie).

    Two small actions: a count, and a hash sample of about
    ``oversample * n / rows_per_slice`` keys (bounded by the parameters, not by
    the data: at most ``oversample * MAX_SLICES`` values reach the driver).
    """
    if rows_per_slice < 1:
        raise ValueError("rows_per_slice must be >= 1")
    n = df.count() if n_rows is None else n_rows
    rows_per_slice = max(rows_per_slice, math.ceil(n / MAX_SLICES))
    k = max(math.ceil(n / rows_per_slice), min(MIN_SLICES, n))
    if k <= 1:  # no row or one
        return SlicePlan([-math.inf, math.inf], [], rows_per_slice, n, tie_kind)
    rate = min(1.0, oversample * k / n)
    u = (F.xxhash64(F.col(tie), F.lit(seed)).bitwiseAND(F.lit(_MASK53)).cast("double")
         / float(1 << 53))
    sample = sorted(r[0] for r in df.filter(u < rate).select(F.col(key).cast("double")).collect())
    m = len(sample)
    if m == 0:
        return SlicePlan([-math.inf, math.inf], [], rows_per_slice, n, tie_kind)
    cands = [sample[min(m - 1, (i * m) // k)] for i in range(1, k)]
    counts: dict[int, int] = {}
    for c in cands:
        counts[c] = counts.get(c, 0) + 1
    heavy_vals = {v for v, c in counts.items() if c >= 2}
    pts = {float(c) for c in cands}
    hv = {float(v) for v in heavy_vals}
    for v in hv:  # isolate [v, next double): a bucket holding the one value v
        pts.add(v)
        pts.add(math.nextafter(v, math.inf))
    splits = [-math.inf] + sorted(pts) + [math.inf]
    heavy = [i for i in range(len(splits) - 1)
             if splits[i] in hv and splits[i + 1] == math.nextafter(splits[i], math.inf)]
    return SlicePlan(splits, heavy, rows_per_slice, n, tie_kind)


def with_slices(df: DataFrame, plan: SlicePlan, key: str, tie: str) -> DataFrame:
    """Add ``_sb`` (bucket) and ``_ss`` (sub-slice) columns."""
    if plan.n_buckets == 1:
        return df.withColumn(B, F.lit(0)).withColumn(S, F.lit(0).cast("long"))
    tmp = "_skey"
    bk = Bucketizer(splits=plan.splits, inputCol=tmp, outputCol=B)
    out = bk.transform(df.withColumn(tmp, F.col(key).cast("double"))).drop(tmp)
    out = out.withColumn(B, F.col(B).cast("int"))
    if plan.heavy_buckets:
        if plan.tie_kind == "dense":  # unique row index: at most rows_per_slice per sub-slice
            piece = F.floor(F.col(tie) / F.lit(plan.rows_per_slice))
        else:  # 64-bit hash spread over as many sub-slices as the data has slices
            k = max(1, math.ceil(plan.n_rows / plan.rows_per_slice))
            piece = F.floor((F.col(tie).cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)) * F.lit(k))
        sub = F.when(F.col(B).isin(plan.heavy_buckets), piece).otherwise(F.lit(0))
    else:
        sub = F.lit(0)
    return out.withColumn(S, sub.cast("long"))


def slice_offsets(sliced: DataFrame) -> DataFrame:
    """Exact row count and starting offset of every slice (tiny, one row per slice)."""
    rows = sliced.groupBy(B, S).agg(F.count(F.lit(1)).alias("_n")).collect()
    acc, out = 0, []
    for r in sorted(rows, key=lambda r: (r[B], r[S])):
        out.append((r[B], r[S], acc))
        acc += r["_n"]
    spark = sliced.sparkSession
    return spark.createDataFrame(out, f"{B} int, {S} long, _off long")


def global_position(df: DataFrame, key: str, tie: str, pos_col: str = "pos",
                    plan: SlicePlan | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """0-based position of every row in (key, tie) order.

    One shuffle (rows hashed by slice for ``row_number`` inside the slice) plus
    a broadcast of the slice offsets, whose size is the number of slices
    (checked against ``MAX_SLICES``).  Persist ``df`` first: it is read by the
    planning actions and by the final job.
    """
    plan = plan or plan_slices(df, key, tie, rows_per_slice)
    sliced = with_slices(df.drop(B, S), plan, key, tie)
    off = slice_offsets(sliced)
    w = Window.partitionBy(B, S).orderBy(F.col(key), F.col(tie))
    return (sliced.withColumn("_rn", F.row_number().over(w))
            .join(F.broadcast(off), [B, S])
            .withColumn(pos_col, F.col("_off") + F.col("_rn") - F.lit(1))
            .drop("_rn", "_off", B, S))


def dense_ids(df: DataFrame, key: str, id_col: str = "id",
              rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Consecutive 0-based ids over the distinct values of a numeric ``key``
    (W4: numbering of non-empty windows), without a single-task window."""
    return global_position(df.select(key).distinct(), key, key, id_col, rows_per_slice=rows_per_slice)


def running_sum(df: DataFrame, key: str, tie: str, value_col: str, out_col: str = "cum",
                rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Inclusive running sum of ``value_col`` in (key, tie) order, without a
    single-task window: per-slice totals (tiny) give each slice's base, the
    window runs inside slices only."""
    plan = plan_slices(df, key, tie, rows_per_slice)
    sliced = with_slices(df, plan, key, tie)
    rows = sliced.groupBy(B, S).agg(F.sum(value_col).alias("_t")).collect()
    acc, out = 0, []
    for r in sorted(rows, key=lambda r: (r[B], r[S])):
        out.append((r[B], r[S], float(acc)))
        acc += r["_t"] or 0
    base = sliced.sparkSession.createDataFrame(out, f"{B} int, {S} long, _base double")
    w = (Window.partitionBy(B, S).orderBy(F.col(key), F.col(tie))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (sliced.withColumn("_in", F.sum(value_col).over(w))
            .join(F.broadcast(base), [B, S])
            .withColumn(out_col, F.col("_base") + F.col("_in"))
            .drop("_in", "_base", B, S))


#: Points of the quantile sketch, its accuracy (ranks are right within n / ACCURACY), and rows of a
#: bracket that are read as they are.
GRID, ACCURACY, BRACKET_ROWS = 1000, 10_000, 200_000


def order_statistics(df: DataFrame, col: str, ranks, rows_per_slice: int = BRACKET_ROWS,
                     n: int | None = None) -> tuple[int, dict[int, float]]:
    """(number of non-null values n, {rank: value}) for 0-based ``ranks``: a list, or a function
    of n that gives one.

    A mergeable sketch of the column gives a grid of values; the two grid points around a rank bracket it, and one pass
    counts the values below, at and between the brackets of all ranks.  A rank at one of the two points is
    found.  Strictly between them lie a few thousandths of the rows at most, however often single values
    repeat: they are sketched again, until ``rows_per_slice`` or fewer are left to be read as (value, count).
    No buffer holds all values and nothing is sorted as a whole.  A caller that knows ``n`` saves its count."""
    vals = (df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
            .persist(StorageLevel.MEMORY_AND_DISK))
    v, grid = F.col("_v"), [i / GRID for i in range(GRID + 1)]

    def within(span):
        lo, hi = span
        return (F.lit(True) if lo is None else v > lo) & (F.lit(True) if hi is None else v < hi)

    try:
        n = vals.count() if n is None else n
        wanted = {r for r in (ranks(n) if callable(ranks) else ranks) if 0 <= r < n}
        got: dict[int, float] = {}
        at = {r: ((None, None), 0, n) for r in wanted}  # rank -> open interval of its value, rows below it, rows in it
        while at:
            spans = {span: (below, inside) for span, below, inside in at.values()}
            few = [s for s, (_, inside) in spans.items() if inside <= rows_per_slice]
            for span in few:
                acc = spans[span][0]
                for value, count in sorted(tuple(r) for r in vals.filter(within(span)).groupBy("_v").count().collect()):
                    got.update({r: value for r, x in at.items() if x[0] == span and acc <= r < acc + count})
                    acc += count
            at = {r: x for r, x in at.items() if r not in got}
            wide = [s for s in spans if s not in few]
            if not wide:
                break
            sketch = F.percentile_approx
            points = vals.agg(*[sketch(F.when(within(s), v), grid, ACCURACY).alias(f"g{i}") for i, s in enumerate(wide)]).first()
            points = {s: points[f"g{i}"] for i, s in enumerate(wide)}
            near = {}
            for r, (span, below, inside) in at.items():
                i = (r - below) * GRID / inside
                near[r] = (points[span][max(math.floor(i) - 1, 0)], points[span][min(math.ceil(i) + 1, GRID)])
            pairs = sorted(set(near.values()))
            counts = vals.agg(*[F.count_if(c).alias(f"{k}{i}") for i, (p, q) in enumerate(pairs) for k, c in (
                ("a", v < p), ("b", v == p), ("c", (v > p) & (v < q)), ("d", v == q))]).first()
            for r, (span, below, inside) in list(at.items()):
                p, q = near[r]
                a, b, c, d = (counts[f"{k}{pairs.index((p, q))}"] for k in "abcd")
                d = d if p < q else 0  # else counted as b
                if r < a:  # the sketch was off by more than the margin
                    at[r] = ((span[0], p), below, a - below)
                elif r < a + b:
                    got[r] = p
                elif r < a + b + c:
                    at[r] = ((p, q), a + b, c)
                elif r < a + b + c + d:
                    got[r] = q
                else:
                    at[r] = ((q, span[1]), a + b + c + d, below + inside - a - b - c - d)
            at = {r: x for r, x in at.items() if r not in got}
        return n, got
    finally:
        vals.unpersist()


def quantiles_exact(df: DataFrame, col: str, qs: list[float],
                    rows_per_slice: int = BRACKET_ROWS) -> list[float | None]:
    """Exact quantiles with linear interpolation (numpy's default); None without values."""
    def ranks(n):
        return [f(q * (n - 1)) for q in qs for f in (math.floor, math.ceil)] if n else []

    n, got = order_statistics(df, col, ranks, rows_per_slice)
    if not n:
        return [None] * len(qs)
    out = []
    for q in qs:
        r = q * (n - 1)
        lo, hi = got[math.floor(r)], got[math.ceil(r)]
        out.append(lo + (r - math.floor(r)) * (hi - lo))
    return out


def quantile_exact(df: DataFrame, col: str, q: float,
                   rows_per_slice: int = BRACKET_ROWS) -> float | None:
    return quantiles_exact(df, col, [q], rows_per_slice)[0]
