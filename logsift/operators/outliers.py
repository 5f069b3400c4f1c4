"""Window outlier reports: threshold (OD3), top-N (T3), ground truth from
block labels (J4) and evaluation (OD7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.operators import metrics as M
from logsift.operators.order import quantile_exact


def contamination_threshold(scored: DataFrame, contamination: float = 0.1,
                            score_col: str = "anomaly_score") -> float | None:
    """Linear-interpolated ``contamination`` quantile of the scores (exact)."""
    return quantile_exact(scored, score_col, contamination)


def flag(scored: DataFrame, threshold: float, score_col: str = "anomaly_score") -> DataFrame:
    """``prediction`` 1 = normal / 0 = anomaly (score below threshold), ``is_anomaly``."""
    normal = (F.col(score_col) >= F.lit(threshold)).cast("int")
    return scored.withColumn("prediction", normal).withColumn("is_anomaly", 1 - normal)


def top_anomalous(scored: DataFrame, top_n: int = 10, score_col: str = "anomaly_score",
                  key: str = "window_id") -> DataFrame:
    """The ``top_n`` lowest scores (ties by key) -- a TakeOrdered, no full sort."""
    return scored.orderBy(F.col(score_col).asc(), F.col(key).asc()).limit(top_n)


def window_truth(membership: DataFrame, labels: DataFrame, window_col: str = "_j") -> DataFrame:
    """Windows holding at least one log of an anomalous block -> (window, truth=1).

    (window, block) pairs are de-duplicated map-side first, so a hot block
    contributes one row per window it touches before the join."""
    bad = labels.filter(F.col("label") == "Anomaly").select("block_key")
    pairs = (membership.filter(F.col("block_id").isNotNull())
             .select(window_col, F.concat(F.lit("block_"), F.col("block_id")).alias("block_key"))
             .distinct())
    return pairs.join(bad, "block_key").select(window_col).distinct().withColumn("truth", F.lit(1))


def evaluate_windows(predicted: DataFrame, truth: DataFrame, key: str = "window_id") -> DataFrame:
    """OD7: precision / recall / F1 of ``is_anomaly`` against block-derived truth,
    the four cells and totals (one row)."""
    j = predicted.join(truth, key, "left").withColumn("truth", F.coalesce(F.col("truth"), F.lit(0)))
    return M.binary_metrics(j, "truth", "is_anomaly")
