"""Classification metrics as aggregates (ML5-ML7, ML9, A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.operators import order as O


def _cells(df: DataFrame, label: str, pred: str, group: list[str] | None = None) -> DataFrame:
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    aggs = [F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def _div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction",
              group: list[str] | None = None) -> DataFrame:
    """ML6: all four (label, prediction) cells, zero-filled."""
    g = group or []
    c = _cells(df, label, pred, g)
    return c.select(*g, F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) "
                               "as (label, prediction, n)"))


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction",
                 group: list[str] | None = None) -> DataFrame:
    """ML5: precision, recall, f1, support per class plus macro / weighted
    averages (0 where a denominator is 0)."""
    g = group or []
    c = _cells(df, label, pred, g)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    c = c.select(*g, p1.alias("p1"), r1.alias("r1"), p0.alias("p0"), r0.alias("r0"),
                 (tp + fn).alias("s1"), (tn + fp).alias("s0"))
    f = lambda p, r: _div(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))
    c = c.withColumn("f1_1", f("p1", "r1")).withColumn("f1_0", f("p0", "r0"))
    tot = F.col("s0") + F.col("s1")
    p0, p1, r0, r1 = F.col("p0"), F.col("p1"), F.col("r0"), F.col("r1")
    f0, f1, s0, s1 = F.col("f1_0"), F.col("f1_1"), F.col("s0"), F.col("s1")

    def row(name, prec, rec, f, sup):
        return F.struct(F.lit(name).alias("class"), prec.cast("double").alias("precision"),
                        rec.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        sup.cast("long").alias("support"))

    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
        row("weighted avg", _div(p0 * s0 + p1 * s1, tot), _div(r0 * s0 + r1 * s1, tot),
            _div(f0 * s0 + f1 * s1, tot), tot))
    # one aggregate, four rows: no union re-running the input per row
    return c.select(*g, F.inline(rows))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                   group: list[str] | None = None) -> DataFrame:
    """Positive-class precision / recall / f1, the four cells and totals (OD7 form)."""
    g = group or []
    c = _cells(df, label, pred, g)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    return c.select(*g, prec.alias("precision"), rec.alias("recall"),
                    _div(2 * prec * rec, prec + rec).alias("f1_score"),
                    tp.alias("true_positives"), fp.alias("false_positives"),
                    tn.alias("true_negatives"), fn.alias("false_negatives"),
                    (tp + fp + tn + fn).alias("total"), (tp + fn).alias("actual_positives"),
                    (tp + fp).alias("predicted_positives"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ML7: exact ROC-AUC with ties averaged (Mann-Whitney on distinct scores).

    Distinct scores carry (positives, negatives); negatives strictly below a
    score come from a slice-based running sum, so no single task orders all
    scores.  One row: auc (NULL when a class is missing), positives, negatives."""
    y = F.col(label).cast("int")
    per = (df.groupBy(F.col(score).cast("double").alias("_s"))
           .agg(F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg")))
    cum = O.running_sum(per, "_s", "_s", "_neg", "_cneg")
    part = cum.select((F.col("_pos") * (F.col("_cneg") - F.col("_neg") * 0.5)).alias("_u"),
                      "_pos", "_neg")
    t = part.agg(F.sum("_u").alias("u"), F.sum("_pos").alias("positives"),
                 F.sum("_neg").alias("negatives"))
    return t.select(F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
                           F.col("u") / (F.col("positives") * F.col("negatives"))).alias("auc"),
                    F.col("positives").cast("long").alias("positives"),
                    F.col("negatives").cast("long").alias("negatives"))


def score_range(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """A12."""
    return df.agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"))
