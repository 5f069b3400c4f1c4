"""End-to-end runs: block supervised detection, window unsupervised detection.

Parameters replace the original YAML keys (defaults: count window 100 / 0,
time window 60 s / 0, 1000 text features, n-grams 1-2, test 0.2, validation
0.1, 100 trees, contamination 0.1).
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.operators import features as FT
from logsift.operators import iforest as IF
from logsift.operators import labels as L
from logsift.operators import outliers as OL
from logsift.operators import sequences as Q
from logsift.operators import split as SP
from logsift.operators import supervised as SV
from logsift.session import staged


@dataclass
class BlockRun:
    dataset: DataFrame            # block training set (A5)
    features: DataFrame           # dataset + split + feature vector
    feature_model: FT.FeatureModel
    models: dict
    report: DataFrame | None = None
    auc: DataFrame | None = None
    confusion: DataFrame | None = None
    stats: dict = field(default_factory=dict)
    predictions: DataFrame | None = None  # ML8: model, block, true, predicted, probability


@dataclass
class WindowRun:
    dataset: DataFrame            # count windows (A3)
    features: DataFrame
    feature_model: FT.FeatureModel
    forest: IF.IsolationForestModel
    scored: DataFrame             # window_id, anomaly_score, prediction, is_anomaly
    top: DataFrame
    evaluation: DataFrame | None = None
    stats: dict = field(default_factory=dict)
    #: every fitted detector by name, as ``api.train_window_models`` gives them
    models: dict = field(default_factory=dict)
    cached: list = field(default_factory=list)

    def release(self) -> None:
        """Drop the persisted tables of the run."""
        for df in self.cached:
            df.unpersist()


def block_features(ordered: Q.OrderedLogs, labels: DataFrame, max_features: int = 1000,
                   ngram_range=(1, 2), fit_scope: str = "all"):
    """Training set + sparse features.  ``fit_scope='all'`` fits vocabulary and
    scaler on every labelled row (the original behaviour, D10); ``'train'`` on
    the train split only."""
    seqs = Q.block_sequences(ordered)
    ds = L.block_training(seqs, labels)
    # the sequences themselves stay behind: keys, label and metadata are all that training needs
    usable = (ds.filter(F.col("anomaly_binary_val").isin(0, 1))
              .select(F.col("block_id").alias("seq_id"), F.col("anomaly_binary_val").alias("label"), *FT.BLOCK_META))
    usable = SP.stratified_split(usable, "seq_id", "label").persist(StorageLevel.MEMORY_AND_DISK)
    pieces = Q.block_pieces(ordered).join(usable.select("seq_id"), "seq_id", "left_semi")
    fit_rows = usable if fit_scope == "all" else usable.filter(F.col("split") == "train")
    fit_pieces = pieces if fit_scope == "all" else pieces.join(
        fit_rows.select("seq_id"), "seq_id", "left_semi")
    fm = FT.fit_features(fit_rows, fit_pieces, "seq_id", FT.BLOCK_META, max_features, ngram_range)
    ft = FT.feature_table(usable, pieces, "seq_id", fm)
    ft = staged(ft.select("seq_id", "label", "split", SV.to_vector(fm.size).alias("features")), "block-features")
    usable.unpersist()
    return ds, ft, fm


def run_blocks(ordered: Q.OrderedLogs, labels: DataFrame, max_features: int = 1000,
               ngram_range=(1, 2), models=SV.MODEL_NAMES, fit_scope: str = "all",
               gbt_iters: int = 100) -> BlockRun:
    ds, ft, fm = block_features(ordered, labels, max_features, ngram_range, fit_scope)
    counts = {(r["split"], r["label"]): r["n"] for r in
              ft.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = ds.count()
    usable = sum(counts.values())
    per_split = {sp: sum(n for (s, _), n in counts.items() if s == sp)
                 for sp in ("train", "validation", "test")}
    # fixed values: the names of the training statistics
    stats = {"total_samples": total, "unlabelled_dropped": total - usable,
             "train_samples": per_split["train"], "val_samples": per_split["validation"],
             "test_samples": per_split["test"],
             "anomaly_rate": (sum(n for (_, y), n in counts.items() if y == 1) / usable) if usable else None,
             "feature_count": fm.size, "tfidf_features": fm.tfidf.size}
    train_classes = {y for (s, y), n in counts.items() if s == "train" and n > 0}
    if train_classes != {0, 1}:
        # Nothing to learn from (no blocks, or one class only) -> empty results, no exception
        stats["skipped"] = "training split needs both classes"
        return BlockRun(ds, ft, fm, {}, None, None, None, stats)
    train = ft.filter(F.col("split") == "train")
    began = time.time()
    fitted = SV.train_block_models(train, "label", "features", models, gbt_iters=gbt_iters)
    stats["training_time"], stats["models_trained"] = time.time() - began, ",".join(fitted)
    report, auc, conf = SV.evaluate(fitted, ft, "label")
    test = ft.filter(F.col("split") == "test")
    preds = None
    for name in fitted:
        p = (SV.predict(fitted, test, name)
             .select(F.lit(name).alias("model"), F.col("seq_id").alias("block_id"),
                     F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"),
                     F.col("probability").alias("y_proba")))
        preds = p if preds is None else preds.unionByName(p)
    return BlockRun(ds, ft, fm, fitted, report, auc, conf, stats, preds)


def training_stats(run: BlockRun | WindowRun, spark) -> DataFrame:
    """A11 as a one-row DataFrame."""
    keys = sorted(run.stats)
    return spark.createDataFrame([tuple(str(run.stats[k]) for k in keys)],
                                 ", ".join(f"`{k}` string" for k in keys))


def window_features(ordered: Q.OrderedLogs, window_size: int = 100, overlap: int = 0,
                    max_features: int = 1000, ngram_range=(1, 2)):
    pos = Q.log_positions(ordered).persist(StorageLevel.MEMORY_AND_DISK)
    windows = Q.count_windows(ordered, window_size, overlap, positions=pos)
    windows = staged(windows, "windows")  # a written table cuts the lineage of all that follows
    pieces = Q.window_pieces(windows)
    n = windows.count()
    fm = FT.fit_features(windows, pieces, "window_id", FT.WINDOW_META, max_features, ngram_range,
                         n_docs=n)
    ft = staged(FT.feature_table(windows, pieces, "window_id", fm), "window-features")
    return pos, windows, ft, fm, n


def run_windows(ordered: Q.OrderedLogs, labels: DataFrame | None = None, window_size: int = 100,
                overlap: int = 0, max_features: int = 1000, ngram_range=(1, 2), n_trees: int = 100,
                contamination: float = 0.1, top_n: int = 10, seed: int = 42,
                models=("isolation_forest", "robust_covariance", "local_outlier_factor"),
                pca: int | None = 10) -> WindowRun:
    """Windows, features, the named detectors (the isolation forest is always among them and
    gives scores, top list and evaluation; the other two see ``pca`` principal components of all
    features, or with None the metadata alone) and the reports.  One window alone has no
    neighbours: the other two need two."""
    from logsift.api import train_window_models
    began = time.time()
    pos, windows, ft, fm, n = window_features(ordered, window_size, overlap, max_features,
                                              ngram_range)
    forest = IF.fit_isolation_forest(ft, "window_id", fm.size, n_trees=n_trees,
                                     contamination=contamination, seed=seed, n_rows=n)
    others = [m for m in models if m != "isolation_forest"] if n > 1 else []
    fitted = {"isolation_forest": forest, **train_window_models(
        ft, "window_id", fm.size, [c + "_scaled" for c in FT.WINDOW_META], others, contamination, seed, pca)}
    scored = staged(forest.predict(forest.score(ft, "window_id")), "window-scores")
    meta = windows.select("window_id", "log_count", "time_span")
    top = OL.top_anomalous(scored.join(meta, "window_id"), top_n)
    evaluation = None
    if labels is not None:
        mem = Q.count_window_membership(pos, ordered.n_rows, window_size, overlap)
        truth = OL.window_truth(mem, labels).select(
            F.concat(F.lit("window_"), F.col("_j").cast("string")).alias("window_id"), "truth")
        evaluation = OL.evaluate_windows(scored, truth)
    return WindowRun(windows, ft, fm, forest, scored, top, evaluation,
                     {"total_windows": n, "feature_count": fm.size,
                      "tfidf_features": fm.tfidf.size, "threshold": forest.offset,
                      "models_trained": ",".join(fitted), "training_time": time.time() - began},
                     fitted, [pos])
