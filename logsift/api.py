"""Public surface: one import for the operators, under the names a user of the
original tool would look for.  DataFrames in, DataFrames out; parameters
replace the original configuration keys."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from logsift.operators.features import fit_features, feature_table, scale, tfidf  # noqa: F401
from logsift.operators.iforest import fit_isolation_forest
from logsift.operators.labels import block_training, column_summary, label_distribution  # noqa: F401
from logsift.operators.lof import local_outlier_factor
from logsift.operators.metrics import binary_metrics, class_report, confusion, roc_auc  # noqa: F401
from logsift.operators.outliers import evaluate_windows, top_anomalous  # noqa: F401
from logsift.operators.robust_cov import fit_robust_covariance
from logsift.operators.sequences import (block_sequences, count_windows, order_logs,  # noqa: F401
                                         sequence_logs, sequence_stats, time_windows)
from logsift.operators.split import stratified_split as split  # noqa: F401
from logsift.operators.supervised import predict as predict_blocks  # noqa: F401
from logsift.operators.supervised import train_block_models  # noqa: F401
from logsift.operators.templates import mine_templates  # noqa: F401
from logsift.plans.runs import run_blocks, run_windows, window_features  # noqa: F401
from logsift.sources.io import (load_block_data, load_models, load_window_data,  # noqa: F401
                                save_dataset, save_models)
from logsift.sources.labels import read_labels  # noqa: F401
from logsift.sources.logs import parse_logs, read_log_text  # noqa: F401

WINDOW_MODELS = ("isolation_forest", "robust_covariance", "local_outlier_factor")
#: Robust covariance and LOF see all text and metadata features by so many principal components.
COMPONENTS = 10


def principal_columns(features: DataFrame, key: str, dim: int, k: int) -> tuple[DataFrame, list[str]]:
    """The sparse text and metadata features reduced to ``k`` principal components (Spark ML PCA): (key, pc0..)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from logsift.operators.supervised import to_vector
    rows = features.select(key, to_vector(dim).alias("_v"))
    out = PCA(k=min(k, dim), inputCol="_v", outputCol="_p").fit(rows).transform(rows)
    cols = [f"pc{i}" for i in range(min(k, dim))]
    return out.select(key, *[vector_to_array(F.col("_p"))[i].alias(c) for i, c in enumerate(cols)]), cols


def train_window_models(features: DataFrame, key: str, dim: int, meta_cols: list[str],
                        models=WINDOW_MODELS, contamination: float | None = 0.1, seed: int = 42,
                        pca: int | None = COMPONENTS) -> dict:
    """Unsupervised window models: isolation forest on the full sparse features;
    robust covariance and LOF on ``pca`` principal components of all features (exact
    neighbours in many dimensions are all pairs) or, with ``pca=None``, on the scaled
    metadata columns alone.  Robust covariance and LOF come with the rows they score."""
    out = {}
    unknown = set(models) - set(WINDOW_MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    if "isolation_forest" in models:
        out["isolation_forest"] = fit_isolation_forest(features, key, dim, contamination=contamination,
                                                       seed=seed)
    low, cols = (features.select(key, *meta_cols), list(meta_cols))
    if pca and {"robust_covariance", "local_outlier_factor"} & set(models):
        low, cols = principal_columns(features, key, dim, pca)
    if "robust_covariance" in models:
        out["robust_covariance"] = (low, fit_robust_covariance(low, cols, contamination, key=key, seed=seed))
    if "local_outlier_factor" in models:
        out["local_outlier_factor"] = local_outlier_factor(low, key, cols, contamination=contamination, seed=seed)
    return out


def score_windows(models: dict, features: DataFrame, key: str,
                  model_name: str = "isolation_forest") -> DataFrame:
    """OD6: (key, anomaly_score, prediction, is_anomaly) with a named model; the last two
    are null for a model fitted without contamination, which has no threshold."""
    from pyspark.sql import functions as F
    if model_name not in models:
        raise ValueError(f"no fitted model named {model_name!r}; fitted: {sorted(models)}")
    m = models[model_name]
    if model_name == "isolation_forest":
        scored, offset = m.score(features, key), m.offset
    elif model_name == "robust_covariance":
        scored, offset = m[1].score(m[0]), m[1].offset
    else:  # LOF scores the rows it was fitted on (transductive, as the library form)
        scored, offset = m[0], m[1].offset
    normal = (F.col("anomaly_score") >= F.lit(offset)).cast("int")
    return scored.select(key, "anomaly_score").withColumn("prediction", normal).withColumn("is_anomaly", 1 - normal)


def run_all(spark: SparkSession, log_paths, labels_path: str | None, output_dir: str,
            max_lines: int | None = None, output_format: str = "csv",
            time_window=(60, 0), count_window=(100, 0), block_models=("logistic_regression",
                                                                      "boosted_trees")):
    """Full run with the original output layout (SK3): all logs, block logs,
    window logs, block dataset, window dataset, block_models/, window_models/."""
    lines = read_log_text(spark, log_paths, max_lines)
    parsed = parse_logs(lines)
    parsed = parsed.persist()  # with templates: the three log outputs and both runs read it
    ordered = order_logs(parsed)
    labels = read_labels(spark, labels_path)
    p = lambda name: os.path.join(output_dir, name)
    from logsift.operators.sequences import block_logs, window_logs
    save_dataset(sequence_logs(ordered, *time_window), p(f"all_logs.{output_format}"), output_format)
    save_dataset(block_logs(ordered), p(f"block_logs.{output_format}"), output_format)
    save_dataset(window_logs(ordered, *time_window), p(f"window_logs.{output_format}"), output_format)
    blocks = run_blocks(ordered, labels, models=block_models)
    save_dataset(blocks.dataset, p(f"block_sequences.{output_format}"), output_format)
    save_models(spark, p("block_models"), blocks.feature_model, blocks.models, stats=blocks.stats)
    windows = run_windows(ordered, labels, *count_window)
    save_dataset(windows.dataset, p(f"window_sequences.{output_format}"), output_format)
    covariance = windows.models.get("robust_covariance")
    save_models(spark, p("window_models"), windows.feature_model, forest=windows.forest,
                covariance=covariance and covariance[1], stats=windows.stats)
    ordered.release()
    parsed.unpersist()
    return blocks, windows
