"""Model properties: isolation forest, template mining, supervised models, I/O."""

import hashlib
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.operators import iforest as IF
from logsift.operators.templates import mine_templates
from logsift.plans import queries as R
from logsift.plans.runs import run_blocks
from logsift.sources import io as IO

from conftest import SF01


def _planted(spark, n=600, out=12, d=4, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, size=(n, d))
    x[:out] += 9.0
    rows = [(f"w{i:04d}", list(range(d)), [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "window_id string, feat_idx array<int>, feat_val array<double>")


def test_isolation_forest_properties(spark):
    df = _planted(spark)
    m1 = IF.fit_isolation_forest(df, "window_id", 4, n_trees=50, contamination=0.1, seed=7)
    m2 = IF.fit_isolation_forest(df, "window_id", 4, n_trees=50, contamination=0.1, seed=7)
    s1 = {r[0]: r[1] for r in m1.score(df, "window_id").collect()}
    s2 = {r[0]: r[1] for r in m2.score(df, "window_id").collect()}
    assert s1 == s2                                            # same seed -> same scores
    assert all(-1.0 <= v < 0.0 for v in s1.values())           # scores in [-1, 0)
    top = sorted(s1, key=lambda k: s1[k])[:12]
    assert sum(k < "w0012" for k in top) >= 11                 # planted outliers lead
    flagged = m1.predict(m1.score(df, "window_id")).agg(F.avg("is_anomaly")).first()[0]
    assert abs(flagged - 0.1) < 0.02                           # share ~ contamination


def test_template_mining_properties(spark):
    p = R.G.parse_logs(R.X.log_lines(spark, SF01), templates=None)
    mined = mine_templates(p)
    rows = mined.select("template_id", "template_str", "message").collect()
    by_id = {}
    for r in rows:
        tpl = r["template_str"].split(" ")
        toks = r["message"].split()
        assert len(tpl) == len(toks)                           # same token count per id
        assert all(a == "<*>" or a == b for a, b in zip(tpl, toks))  # template matches member
        by_id.setdefault(r["template_id"], set()).add(r["template_str"])
    assert all(len(v) == 1 for v in by_id.values())
    again = mine_templates(p.repartition(7))
    a = {r["line_no"]: r["template_id"] for r in mined.select("line_no", "template_id").collect()}
    b = {r["line_no"]: r["template_id"] for r in again.select("line_no", "template_id").collect()}
    assert a == b                                              # partitioning does not change ids


def test_supervised_and_io_round_trip(spark):
    o = R.ordered_fixture(spark, SF01)
    run = run_blocks(o, R.labels_fixture(spark, SF01), models=("logistic_regression",))
    auc = {r["split"]: r["auc"] for r in run.auc.collect()}
    assert auc["test"] > 0.8                                   # planted frequency signal
    n_test = run.features.filter("split = 'test'").count()
    assert run.predictions.count() == n_test                   # ML8: one row per test block
    d = tempfile.mkdtemp(prefix="logsift-models-")
    IO.save_models(spark, d, run.feature_model, run.models, stats={"rows": 1})
    back = IO.load_models(spark, d)
    assert back["feature_model"].tfidf.terms == run.feature_model.tfidf.terms
    assert back["feature_names"] == run.feature_model.names
    p1 = run.models["logistic_regression"].transform(run.features).select("prediction").collect()
    p2 = back["models"]["logistic_regression"].transform(run.features).select("prediction").collect()
    assert p1 == p2


def test_dataset_round_trip(spark):
    t = R._training(spark, SF01)
    d = tempfile.mkdtemp(prefix="logsift-ds-")
    for fmt in ("csv", "json", "parquet"):
        path = f"{d}/blocks.{fmt}"
        IO.save_dataset(t, path, fmt)
        back = IO.load_block_data(spark, path)
        assert back.count() == t.count()
        assert sorted(r[0] for r in back.select("template_sequence_str").collect()) == \
            sorted(r[0] for r in t.select("template_sequence_str").collect())
    with pytest.raises(ValueError):
        IO.save_dataset(t, f"{d}/x.pkl", "pickle")
    with pytest.raises(ValueError):
        IO.load_block_data(spark, f"{d}/x.pkl")


def _lof_brute(x, k):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    nb = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = d[np.arange(n)[:, None], nb][:, -1]
    reach = np.maximum(kd[nb], d[np.arange(n)[:, None], nb])
    lrd = 1.0 / (reach.mean(axis=1) + 1e-10)
    return lrd[nb].mean(axis=1) / lrd


def test_lof_multi_leaf_matches_brute_force(spark):
    from logsift.operators.lof import local_outlier_factor
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, size=(300, 2)), 3)
    x[:5] = x[5]                                   # duplicates
    x[-3:] += 6.0                                  # outliers
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)],
                               "id long, a double, b double")
    out, model = local_outlier_factor(df, "id", ["a", "b"], 10, contamination=0.05, leaf_size=8)
    got = {r["id"]: r["lof"] for r in out.collect()}
    want = _lof_brute(x, 10)
    assert len(got) == 300
    assert max(abs(got[i] - want[i]) for i in range(300)) < 1e-6
    assert model.offset is not None


def test_nearest_by_matrix_product_equals_brute_force():
    """Ties, copies and points far from zero, as batches come by in any order."""
    from logsift.operators.lof import _Nearest
    rng = np.random.default_rng(8)
    for x in (rng.integers(0, 4, (300, 3)).astype(float), rng.normal(size=(400, 64)), 1e6 + 1e-4 * rng.normal(size=(300, 5))):
        x = np.unique(x, axis=0)
        pid, m = rng.permutation(len(x)), rng.integers(1, 4, len(x))
        near = _Nearest(pid, x, 7)
        for part in np.array_split(rng.permutation(len(x)), 9):
            near.add(np.arange(len(x)), pid[part], x[part], m[part])
        near.settle()
        for i in range(len(x)):
            d, w, want, left = np.sqrt(((x - x[i]) ** 2).sum(axis=1)), m - (np.arange(len(x)) == i), [], 7
            for j in np.lexsort((pid, d)):
                if w[j] and left:
                    want.append((pid[j], d[j], min(w[j], left)))
                    left -= min(w[j], left)
            at = near.kept[0] == i
            assert list(zip(*(c[at] for c in near.kept[1:]), strict=True)) == want


def test_lof_many_dimensions_and_strips_match_brute_force(spark):
    from logsift.operators.lof import local_outlier_factor
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 16))
    x[:4] = x[4]
    x[-3:] += 4.0
    cols = [f"c{i}" for i in range(16)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols))
    out, _ = local_outlier_factor(df, "id", cols, 10, contamination=None, leaf_size=30)
    got, want = {r["id"]: r["lof"] for r in out.collect()}, _lof_brute(x, 10)
    assert len(got) == 500 and max(abs(got[i] - want[i]) for i in range(500)) < 1e-6


def test_robust_covariance_properties(spark):
    from logsift.operators.robust_cov import fit_robust_covariance
    rng = np.random.default_rng(0)
    x = rng.multivariate_normal([1, 2, 3], [[1, .5, 0], [.5, 2, .3], [0, .3, 1]], size=1500)
    x[:60] += 8.0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)],
                               "id long, a double, b double, c double")
    m = fit_robust_covariance(df, ["a", "b", "c"], contamination=0.1, key="id")
    assert np.allclose(m.location, [1, 2, 3], atol=0.2)          # outliers do not pull the fit
    pred = m.predict(m.score(df))
    assert pred.filter("id < 60").agg(F.min("is_anomaly")).first()[0] == 1
    share = pred.agg(F.avg("is_anomaly")).first()[0]
    assert abs(share - 0.1) < 0.01


def test_lof_and_robust_covariance_see_the_templates_of_a_window(spark):
    """A window of ordinary size, span and number of templates, but of templates that no other has."""
    from logsift.api import score_windows
    from logsift.operators import sequences as Q
    from logsift.plans.runs import run_windows
    rng = np.random.default_rng(1)
    ids = [t for w in range(40) for t in rng.permutation([*range(1, 6), *rng.integers(1, 6, 15)]) + (10 if w == 20 else 0)]
    rows = [(i, i, "blk_1", int(t)) for i, t in enumerate(ids)]
    df = spark.createDataFrame(rows, "line_no long, s long, block_id string, template_id int")
    df = df.select("line_no", F.timestamp_seconds("s").cast("timestamp_ntz").alias("timestamp"), "block_id", "template_id")
    run = run_windows(Q.order_logs(df), window_size=20, n_trees=5)
    for name in ("robust_covariance", "local_outlier_factor"):
        low = score_windows(run.models, run.features, "window_id", name).orderBy("anomaly_score").limit(2).collect()
        assert low[0]["window_id"] == "window_20" and low[0]["anomaly_score"] < low[1]["anomaly_score"] - 0.1
    run.release()


def test_isolation_forest_trees_by_hand(spark):
    """Every tree against a row-by-row version, with zeros left out, a null value, equal rows and a constant feature."""
    rng = np.random.default_rng(5)
    dense = np.round(rng.normal(size=(40, 3)), 2)
    dense[:, 1] = np.where(dense[:, 1] > 0.4, dense[:, 1], 0.0)
    dense[20:26] = dense[0]
    dense = np.column_stack([dense, np.full(40, 7.0)])
    rows = [(i, [j for j in range(4) if dense[i, j] != 0], [float(v) for v in dense[i] if v != 0]) for i in range(40)]
    dense = np.vstack([dense, [0.0, 0.0, 1.0, 7.0]])
    rows.append((40, [0, 2, 3], [None, 1.0, 7.0]))
    df = spark.createDataFrame(rows, "id long, idx array<int>, val array<double>").repartition(5)
    m = IF.fit_isolation_forest(df, "id", 4, n_trees=6, contamination=None, seed=3, idx_col="idx", val_col="val")
    limit, got = 6, {}
    for r in m.nodes.itertuples():
        got.setdefault(r.tree, {})[r.node] = r

    def grow(tree, ids, heap, depth, node):
        r = got[tree][node]
        assert (r.size, r.depth) == (len(ids), depth)
        grid = np.floor(dense[ids] * IF.GRID + 0.5).astype(np.int64)
        lo, hi = grid.min(0), grid.max(0)
        free = [f for f in range(4) if hi[f] > lo[f]]
        if depth == limit or not free:
            assert r.feature == -1
            return 1
        f = min(free, key=lambda f: hashlib.md5(f"3|{tree}|{heap}|{f}".encode()).hexdigest())
        at = int(lo[f]) + 1 + int(hashlib.md5(f"3|{tree}|{heap}|cut".encode()).hexdigest()[:13], 16) % int(hi[f] - lo[f])
        assert (r.feature, r.threshold) == (f, (at - 0.5) / IF.GRID)
        low = [i for i in ids if dense[i, f] < r.threshold]
        high = [i for i in ids if dense[i, f] >= r.threshold]
        assert low and high
        return 1 + grow(tree, low, 2 * heap + 1, depth + 1, r.left) + grow(tree, high, 2 * heap + 2, depth + 1, r.right)

    assert sorted(got) == list(range(6))
    for tree in got:
        assert grow(tree, list(range(41)), 0, 0, 0) == len(got[tree])


def test_isolation_forest_draws(spark):
    """Each tree takes psi different rows, trees differ, all rows have their turn; one row alone is a leaf."""
    df = spark.range(3000).selectExpr("id", "array(0) as feat_idx", "array(double(id % 2)) as feat_val")
    drawn = IF._draw(df, "id", 100, 256, 512 / 3000, 42).toPandas()
    assert (drawn.groupby("tree")["id"].nunique() == 256).all() and len(drawn) == 25600
    turns = drawn["id"].value_counts().reindex(range(3000), fill_value=0)
    assert abs(turns.mean() - 100 * 256 / 3000) < 1e-9 and 2.0 < turns.std() < 3.8  # binomial: 2.79
    one = IF.fit_isolation_forest(df.limit(1), "id", 1, n_trees=3, contamination=None)
    assert list(one.nodes["size"]) == [1, 1, 1] and one.score(df.limit(1), "id").first()[1] == -1.0
