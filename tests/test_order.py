"""Slice ordering: multi-slice and hot-key paths against brute force."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from logsift.operators import order as O
from logsift.operators import metrics as M


def _hot_instant_rows(n=900, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ts = 5_000_000 if i % 3 == 0 else rnd.randrange(0, 10_000_000)  # a third at one instant
        rows.append((i, ts))
    rnd.shuffle(rows)
    return rows


def test_global_position_hot_instant(spark):
    rows = _hot_instant_rows()
    df = spark.createDataFrame(rows, "line_no long, k long")
    got = {r["line_no"]: r["pos"] for r in
           O.global_position(df, "k", "line_no", rows_per_slice=40).collect()}
    want = {ln: i for i, (ln, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want


def test_slice_plan_isolates_hot_value(spark):
    rows = _hot_instant_rows()
    df = spark.createDataFrame(rows, "line_no long, k long")
    plan = O.plan_slices(df, "k", "line_no", rows_per_slice=40)
    assert plan.heavy_buckets, "a value with a third of the rows must get its own bucket"
    sliced = O.with_slices(df, plan, "k", "line_no")
    biggest = sliced.groupBy(O.B, O.S).count().agg(F.max("count")).first()[0]
    assert biggest <= 3 * 40


def test_dense_ids(spark):
    df = spark.createDataFrame([(k,) for k in [5, 5, 9, 1, 1000, 9, 3]], "k long")
    got = {r["k"]: r["id"] for r in O.dense_ids(df, "k", rows_per_slice=2).collect()}
    assert got == {1: 0, 3: 1, 5: 2, 9: 3, 1000: 4}


def test_running_sum(spark):
    rnd = random.Random(1)
    rows = [(float(i), rnd.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "s double, v long")
    got = {r["s"]: r["cum"] for r in O.running_sum(df, "s", "s", "v", rows_per_slice=17).collect()}
    acc = 0
    for s, v in rows:
        acc += v
        assert got[s] == acc


def test_quantile_exact_with_heavy_value(spark):
    rnd = random.Random(7)
    vals = [0.5 if i % 3 == 0 else rnd.random() for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for q in (0.0, 0.1, 0.33, 0.5, 0.9, 1.0):
        got = O.quantile_exact(df, "x", q, rows_per_slice=30)
        assert abs(got - float(np.percentile(vals, 100 * q))) < 1e-12


def test_roc_auc_brute_force(spark):
    rnd = random.Random(11)
    rows = [(rnd.randrange(2), float(rnd.randrange(20))) for _ in range(400)]  # many ties
    df = spark.createDataFrame(rows, "label int, score double")
    got = M.roc_auc(df, "label", "score").first()["auc"]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12


def test_order_statistics_and_quantiles(spark):
    import numpy as np

    from logsift.operators import order as O

    rng = np.random.default_rng(5)
    values = [float(v) for v in np.concatenate([rng.normal(size=900), np.full(700, 0.25)])]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.5001, 0.9, 1.0]
    for rows in (37, 10_000):
        got = O.quantiles_exact(df, "v", qs, rows_per_slice=rows)
        assert np.allclose(got, np.quantile(values, qs))
        n, picked = O.order_statistics(df, "v", [0, 799, 1599, 5000], rows)
        assert n == 1600 and picked == {r: sorted(values)[r] for r in (0, 799, 1599)}
    assert O.quantiles_exact(df.filter("v is null"), "v", [0.5]) == [None]


def test_order_statistics_by_a_coarse_sketch(spark, monkeypatch):
    """Several rounds of brackets, ranks at their ends, and a sketch that is off."""
    rng = np.random.default_rng(6)
    values = sorted(float(v) for v in np.concatenate([rng.normal(size=1500), np.full(900, -0.5), np.full(900, 0.25), np.repeat([9.0, -9.0], 40)]))
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    monkeypatch.setattr(O, "GRID", 8)
    ranks = [0, 39, 40, 700, 1200, 1699, 1700, 2500, len(values) - 41, len(values) - 1]
    for accuracy in (3, 1000):
        monkeypatch.setattr(O, "ACCURACY", accuracy)
        n, got = O.order_statistics(df, "v", ranks, 5)
        assert n == len(values) and got == {r: values[r] for r in ranks}
