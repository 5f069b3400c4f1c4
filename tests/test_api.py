"""End-to-end run over real text files with the output layout."""

import os
import tempfile

from logsift import api
from logsift.plans import queries as R

from conftest import SF01


def test_run_all_writes_layout(spark):
    d = tempfile.mkdtemp(prefix="logsift-run-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    lines = R.X.log_lines(spark, SF01).orderBy("line_no").collect()
    with open(os.path.join(src, "app.log"), "w") as fh:
        fh.write("\n".join(r["value"] for r in lines) + "\n")
    R.X.label_rows(spark, SF01).coalesce(1).write.option("header", True).csv(os.path.join(d, "labels"))
    out = os.path.join(d, "out")
    blocks, windows = api.run_all(spark, src, os.path.join(d, "labels"), out,
                                  block_models=("logistic_regression",))
    for name in ("all_logs.csv", "block_logs.csv", "window_logs.csv", "block_sequences.csv",
                 "window_sequences.csv", "block_models", "window_models"):
        assert os.path.exists(os.path.join(out, name)), name
    back = api.load_window_data(spark, os.path.join(out, "window_sequences.csv"))
    assert back.count() == windows.dataset.count()
    assert windows.evaluation.first()["total"] == back.count()
    models = api.load_models(spark, os.path.join(out, "window_models"))
    assert models["forest"].offset == windows.forest.offset


def test_empty_logs_give_empty_results(spark):
    from logsift.operators import sequences as Q
    from logsift.sources.logs import parse_logs
    lines = spark.createDataFrame([(0, "not a log line")], "line_no long, value string")
    ordered = Q.order_logs(parse_logs(lines, templates="fixture"))
    assert Q.block_sequences(ordered).count() == 0
    assert Q.time_windows(ordered, 60, 0).count() == 0
    assert Q.count_windows(ordered, 100, 0).count() == 0
    labels = spark.createDataFrame([], "block_key string, label string")
    run = api.run_blocks(ordered, labels)
    assert run.models == {} and run.stats["total_samples"] == 0


def test_train_and_score_window_models(spark):
    import pytest
    from pyspark.sql import functions as F
    from logsift.operators import features as FT

    o = R.ordered_fixture(spark, SF01)
    pos, windows, ft, fm, n = api.window_features(o, 100, 0, 50)
    ft = FT.scale(ft, FT.WINDOW_META)
    meta = [c + "_scaled" for c in FT.WINDOW_META]
    models = api.train_window_models(ft, "window_id", fm.size, meta)
    for name in api.WINDOW_MODELS:
        s = api.score_windows(models, ft, "window_id", name)
        assert s.count() == n
        share = s.agg(F.avg("is_anomaly")).first()[0]
        assert 0.0 < share <= 0.25, (name, share)
    with pytest.raises(ValueError):
        api.score_windows(models, ft, "window_id", "one_class_svm")
