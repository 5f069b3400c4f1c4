"""Isolation forest (OD1 fit, OD2 score) as Spark jobs (Liu, Ting, Zhou 2008).

Fit
  * One md5 per row gives a number a < 2^31 - 1; tree t ranks the rows by (a * m_t + c_t) mod (2^31 - 1)
    and takes the ``psi`` lowest (ties: the rest of the md5, then the key): a uniform sample without
    replacement.  A row is replicated only for the trees where it lies under a bound that 2 psi
    rows are expected to meet, and the chosen <= trees x psi rows get their features back by a join.
  * All trees grow together, level by level: a grouped aggregate over (tree, node, feature) gives
    each node's size and value ranges, the split feature is the one of the non-constant features whose
    md5(seed, tree, node, feature) is lowest, and md5(seed, tree, node) places the cut between its minimum
    and maximum.  A node is a leaf at one row, identical rows, or depth ceil(log2 psi).  Per level
    one row a node (<= trees x psi) reaches the driver and goes back as a broadcast.
  * Ranges are taken on a grid of 2^-30, so that rounding in a sum neither makes a feature
    non-constant nor moves a cut; values beyond +-2^32, and NaN (as the largest), are held to that.
    Null values count as 0, as do the entries that a sparse row lacks.
  * The node table (<= n_trees * (2 psi - 1) rows) is the model; it is saved as parquet.

The same seed gives the same forest on every engine and partitioning; no Python worker takes part.

Score
  ``mapInPandas`` over the feature rows with the node table shipped to each
  task: narrow, no shuffle.  Path length h = depth + c(leaf size);
  score = -2^(-mean h / c(psi)) (lower = more anomalous).  c is held to 2^-32, so sums are exact.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.session import ship_package, staged

EULER = 0.5772156649
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int")
#: Modulus of the row draws (a Mersenne prime: products stay within 64 bits), grid of the cuts, largest value.
PRIME, GRID, LARGEST = (1 << 31) - 1, 1 << 30, float(1 << 32)
#: Chosen rows up to which their keys are broadcast to the feature rows.
BROADCAST_ROWS = 1_000_000


def c_factor(m):
    """Average path length of an unsuccessful BST search over m points."""
    m = np.asarray(m, dtype=float)
    out = np.zeros_like(m)
    big = m > 2
    out[big] = 2.0 * (np.log(m[big] - 1.0) + EULER) - 2.0 * (m[big] - 1.0) / m[big]
    out[m == 2] = 1.0
    return np.rint(out * (1 << 32)) / (1 << 32)


def dense_rows(idx_series: pd.Series, val_series: pd.Series, dim: int) -> np.ndarray:
    """Sparse (indices, values) arrays of a pandas batch -> dense float matrix."""
    n = len(idx_series)
    x = np.zeros((n, dim), dtype=float)
    lens = np.fromiter((len(a) for a in idx_series), dtype=np.int64, count=n)
    if lens.sum():
        rows = np.repeat(np.arange(n), lens)
        cols = np.concatenate([np.asarray(a, dtype=np.int64) for a in idx_series])
        vals = np.concatenate([np.asarray(a, dtype=float) for a in val_series])
        x[rows, cols] = vals
    return x


def _number(text: str) -> int:
    """52 bits of the md5 of ``text``."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def _draw(features: DataFrame, key: str, n_trees: int, psi: int, rate: float, seed: int) -> DataFrame:
    """(tree, key) of the rows that each tree takes."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    a = F.conv(F.substring("_d", 1, 8), 16, 10).cast("bigint") % PRIME
    trees = F.from_json(F.lit(json.dumps([{"tree": t, "m": 1 + _number(f"{seed}|tree|{t}") % (PRIME - 1),
                                           "c": _number(f"{seed}|shift|{t}") % PRIME} for t in range(n_trees)])),
                        "array<struct<tree:int,m:bigint,c:bigint>>")  # a constant
    ranks = F.transform(trees, lambda k: F.struct(k["tree"].alias("tree"), ((F.col("_a") * k["m"] + k["c"]) % PRIME).alias("h")))
    rows = (features.select(key, digest.alias("_d")).select(key, F.substring("_d", 9, 24).alias("_b"), a.alias("_a"))
            .select(key, "_b", F.explode(F.filter(ranks, lambda x: x["h"] < F.lit(rate * PRIME))).alias("_t"))
            .select(key, "_b", "_t.tree", F.col("_t.h").alias("_h")))
    w = Window.partitionBy("tree").orderBy("_h", "_b", key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).select("tree", key)


def _level(rows: DataFrame, seed: int) -> DataFrame:
    """(tree, node, size, pick): ``pick`` is the split feature with its range, null in a node of identical rows."""
    ranges = (rows.select("tree", "node", F.inline("cells"))
              .groupBy("tree", "node", "feature").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi")))
    size = F.max(F.when(F.col("feature") == -1, F.col("n"))).over(Window.partitionBy("tree", "node"))
    ranges = ranges.withColumn("size", size)
    zero = F.when(F.col("n") < F.col("size"), F.lit(0).cast("bigint"))  # null is left out by least and greatest
    lo, hi = F.least("lo", zero), F.greatest("hi", zero)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("tree", "node", "feature")]))
    pick = F.when((F.col("feature") >= 0) & (hi > lo), F.struct(order.alias("order"), "feature", lo.alias("lo"), hi.alias("hi")))
    return ranges.groupBy("tree", "node").agg(F.max("size").alias("size"), F.min(pick).alias("pick"))


def grow_trees(sample: DataFrame, n_trees: int, limit: int, seed: int) -> pd.DataFrame:
    """NODE_SCHEMA rows of all trees from (tree, idx, val)."""
    spark = sample.sparkSession
    # a tree has psi rows at most, so whole trees share a partition and no level shuffles
    one = lambda f, v: F.struct(f.cast("int").alias("feature"), v.cast("bigint").alias("g"))
    grid = lambda v: F.floor(F.greatest(F.least(v.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)) * F.lit(float(GRID)) + F.lit(0.5))
    cells = F.concat(F.array(one(F.lit(-1), F.lit(0))),  # one more cell a row counts the node's rows
                     F.transform(F.arrays_zip(F.col("idx"), F.col("val")), lambda e: one(e["idx"], grid(F.coalesce(e["val"], F.lit(0.0))))))
    sample = sample.withColumn("cells", cells)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = sample.withColumn("node", F.lit(0)).repartition(min(parts, n_trees), "tree").persist()
    before = None
    found: list[tuple] = []  # tree, heap number, feature, threshold, size, depth
    for depth in range(limit + 1):
        if depth < limit:
            level = [(r["tree"], r["node"], r["size"], r["pick"]) for r in _level(rows, seed).collect()]
        else:
            level = [(r["tree"], r["node"], r["count"], None) for r in rows.groupBy("tree", "node").count().collect()]
        if before is not None:
            before.unpersist()  # the level that was just read holds its rows
        cuts = []
        for tree, node, size, pick in level:
            if pick is None:
                found.append((tree, node, -1, 0.0, size, depth))
                continue
            at = pick["lo"] + 1 + _number(f"{seed}|{tree}|{node}|cut") % (pick["hi"] - pick["lo"])
            cuts.append((tree, node, pick["feature"], (at - 0.5) / GRID))
            found.append((*cuts[-1], size, depth))
        if not cuts:
            break
        split = F.broadcast(spark.createDataFrame(cuts, "tree int, node int, feature int, threshold double"))
        place = F.array_position("idx", F.col("feature")).cast("int")
        value = F.when(place > 0, F.coalesce(F.try_element_at("val", place), F.lit(0.0))).otherwise(0.0)
        before = rows
        rows = rows.join(split, ["tree", "node"]).select(
            "tree", "idx", "val", "cells", (F.col("node") * 2 + F.when(value < F.col("threshold"), 1).otherwise(2)).alias("node")).persist()
    rows.unpersist()
    nodes = pd.DataFrame(found, columns=["tree", "heap", "feature", "threshold", "size", "depth"]).sort_values(["tree", "heap"])
    nodes["node"] = nodes.groupby("tree").cumcount()
    number = dict(zip(zip(nodes["tree"], nodes["heap"]), nodes["node"]))
    for side, step in (("left", 1), ("right", 2)):
        nodes[side] = [number[t, 2 * h + step] if f >= 0 else -1 for t, h, f in zip(nodes["tree"], nodes["heap"], nodes["feature"])]
    return nodes[["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]].reset_index(drop=True)


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame          # NODE_SCHEMA columns
    psi: int
    n_trees: int
    dim: int
    contamination: float = 0.1
    offset: float | None = None  # score threshold (OD3)

    def score(self, features: DataFrame, key: str, idx_col: str = "feat_idx",
              val_col: str = "feat_val", out_col: str = "anomaly_score") -> DataFrame:
        """OD2: (key, anomaly_score) for every row; narrow ``mapInPandas``."""
        ship_package(features.sparkSession)
        trees = [g.sort_values("node") for _, g in self.nodes.groupby("tree")]
        packed = [(t["feature"].to_numpy(), t["threshold"].to_numpy(), t["left"].to_numpy(),
                   t["right"].to_numpy(), t["size"].to_numpy(), t["depth"].to_numpy()) for t in trees]
        dim, cpsi = self.dim, float(c_factor([self.psi])[0]) or 1.0
        key_type = features.schema[key].dataType.simpleString()

        def run(batches):
            for pdf in batches:
                for start in range(0, len(pdf), 2048):
                    part = pdf.iloc[start:start + 2048]
                    x = dense_rows(part[idx_col], part[val_col], dim)
                    total = np.zeros(len(part))
                    for feat, thr, left, right, size, depth in packed:
                        node = np.zeros(len(part), dtype=np.int64)
                        active = left[node] >= 0
                        while active.any():
                            r = np.flatnonzero(active)
                            nd = node[r]
                            goes_left = x[r, feat[nd]] < thr[nd]
                            node[r] = np.where(goes_left, left[nd], right[nd])
                            active = left[node] >= 0
                        total += depth[node] + c_factor(size[node])
                    mean_h = total / max(1, len(packed))
                    yield pd.DataFrame({key: part[key].to_numpy(),
                                        out_col: -np.power(2.0, -mean_h / cpsi)})

        return features.select(key, idx_col, val_col).mapInPandas(
            run, f"{key} {key_type}, {out_col} double")

    def predict(self, scored: DataFrame, score_col: str = "anomaly_score") -> DataFrame:
        """PF12 / OD3: ``prediction`` 1 = normal, 0 = anomaly; ``is_anomaly`` = 1 - prediction."""
        if self.offset is None:
            raise ValueError("model has no threshold; call fit with contamination")
        normal = (F.col(score_col) >= F.lit(self.offset)).cast("int")
        return scored.withColumn("prediction", normal).withColumn("is_anomaly", 1 - normal)


def fit_isolation_forest(features: DataFrame, key: str, dim: int, n_trees: int = 100,
                         max_samples: int = 256, contamination: float | None = 0.1, seed: int = 42,
                         idx_col: str = "feat_idx", val_col: str = "feat_val",
                         n_rows: int | None = None) -> IsolationForestModel:
    """OD1 (+ OD3 threshold when ``contamination`` is given)."""
    from logsift.operators.order import quantile_exact

    ship_package(features.sparkSession)
    n = features.count() if n_rows is None else n_rows
    if n == 0:
        raise ValueError("no rows to fit")
    psi = min(max_samples, n)
    limit = int(math.ceil(math.log2(max(psi, 2))))
    chosen = _draw(features, key, n_trees, psi, min(1.0, 2.0 * psi / n), seed)
    if n_trees * psi <= BROADCAST_ROWS:  # a bound by parameters: the feature rows need no shuffle
        chosen = F.broadcast(chosen)
    sample = features.select(key, F.col(idx_col).alias("idx"), F.col(val_col).alias("val")).join(chosen, key)
    nodes = grow_trees(staged(sample.select("tree", "idx", "val"), "forest-sample"), n_trees, limit, seed)
    model = IsolationForestModel(nodes, psi, n_trees, dim, contamination or 0.0)
    if contamination:
        scores = model.score(features, key, idx_col, val_col)
        model.offset = quantile_exact(scores, "anomaly_score", contamination)
    return model
