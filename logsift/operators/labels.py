"""Block training set: sequences + labels (J1, PF11, A5, D3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions import parse as P

BLOCK_TRAINING_COLUMNS = ["block_id", "sequence_length", "template_sequence",
                          "template_sequence_str", "start_time", "end_time", "time_span",
                          "anomaly_binary_val", "anomaly_labels", "anomaly_label"]


def block_training(block_seqs: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join block sequences with labels (one row per block key).

    ``block_id`` holds the sequence id ``block_<id>`` (as the original dataset
    did).  Fixed schema for unlabelled blocks: ``anomaly_binary_val`` and
    ``anomaly_labels`` NULL, ``anomaly_label`` = -1; labelled blocks have
    ``anomaly_label`` NULL.  Labels are one row per key, so the join does not
    multiply rows; AQE broadcasts the label side when it is small."""
    whole = ["template_sequence", P.ids_to_string(F.col("template_sequence")).alias("template_sequence_str")]
    return _labelled(block_seqs, labels, whole)


def block_training_headers(headers: DataFrame, labels: DataFrame) -> DataFrame:
    """The training set without the ids, which stay in the stored piece table: no row grows with its sequence."""
    return _labelled(headers, labels, [])


def _labelled(seqs: DataFrame, labels: DataFrame, more: list) -> DataFrame:
    j = seqs.join(labels, seqs["seq_id"] == labels["block_key"], "left")
    return j.select(
        F.col("seq_id").alias("block_id"),
        F.col("length").alias("sequence_length"),
        *more,
        "start_time", "end_time", "time_span",
        P.label_to_binary(F.col("label")).alias("anomaly_binary_val"),
        F.col("label").alias("anomaly_labels"),
        F.when(F.col("block_key").isNull(), F.lit(-1)).cast("int").alias("anomaly_label"))


def label_distribution(training: DataFrame) -> DataFrame:
    """Rows per target value (NULL = unlabelled)."""
    return training.groupBy("anomaly_binary_val").agg(F.count(F.lit(1)).alias("n"))


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """A10: count, mean, sample std, min, quartiles (exact, interpolated), max."""
    from logsift.operators.order import quantiles_exact

    c = F.col(column).cast("double")
    p25, p50, p75 = (F.lit(q).cast("double") for q in quantiles_exact(df, column, [0.25, 0.5, 0.75]))
    return df.agg(F.lit(column).alias("column"),
                  F.count(c).alias("count"), F.avg(c).alias("mean"),
                  F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
                  F.first(p25).alias("p25"), F.first(p50).alias("p50"),
                  F.first(p75).alias("p75"), F.max(c).alias("max"))
