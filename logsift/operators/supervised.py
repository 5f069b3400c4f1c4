"""Supervised block models (ML2 logistic regression, ML3 boosted trees), ML4
predict and ML9 evaluation, on Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.operators import metrics as M

MODEL_NAMES = ("logistic_regression", "boosted_trees")


def to_vector(dim: int, idx_col: str = "feat_idx", val_col: str = "feat_val") -> F.Column:
    """Sparse ``Vector`` from (indices, values) arrays, without Python.

    SQL has no function for it, but its JSON reader makes any column type from
    the type's stored form, here (0 for sparse, size, indices, values).  Doubles keep
    every bit on the way: JSON holds their shortest exact form."""
    form = T.StructType([T.StructField("v", VectorUDT())])
    stored = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(dim).alias("size"),
                      F.col(idx_col).alias("indices"), F.col(val_col).alias("values"))
    return F.from_json(F.to_json(F.struct(stored.alias("v"))), form)["v"]


def with_weights(train: DataFrame, label: str, scheme: str) -> DataFrame:
    """``balanced``: n / (2 n_class); ``pos``: positives weigh n_neg / n_pos."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if n0 == 0 or n1 == 0:
        raise ValueError("training data needs both classes")
    if scheme == "balanced":
        n = n0 + n1
        w = F.when(F.col(label) == 1, F.lit(n / (2.0 * n1))).otherwise(F.lit(n / (2.0 * n0)))
    elif scheme == "pos":
        w = F.when(F.col(label) == 1, F.lit(n0 / n1)).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown weighting {scheme!r}")
    return train.withColumn("_w", w)


def train_block_models(train: DataFrame, label: str = "label", features: str = "features",
                       models=MODEL_NAMES, seed: int = 42, gbt_weighting: str = "pos",
                       max_iter_lr: int = 1000, gbt_iters: int = 100, gbt_depth: int = 6,
                       gbt_step: float = 0.1, lr_tol: float = 1e-6) -> dict:
    """Fit the named models on the train split (features = ML vector column).

    ``lr_tol``: change of the loss at which the logistic regression stops."""
    out = {}
    if "logistic_regression" in models:
        t = with_weights(train, label, "balanced")
        n = t.count()
        lr = LogisticRegression(featuresCol=features, labelCol=label, weightCol="_w",
                                maxIter=max_iter_lr, regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                                standardization=False, tol=lr_tol)
        out["logistic_regression"] = lr.fit(t)
    if "boosted_trees" in models:
        t = with_weights(train, label, gbt_weighting)
        gbt = GBTClassifier(featuresCol=features, labelCol=label, weightCol="_w", maxIter=gbt_iters,
                            maxDepth=gbt_depth, stepSize=gbt_step, seed=seed)
        out["boosted_trees"] = gbt.fit(t)
    unknown = set(models) - set(MODEL_NAMES)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    return out


def predict(models: dict, df: DataFrame, model_name: str = "logistic_regression",
            features: str = "features") -> DataFrame:
    """ML4: adds ``prediction`` (0/1) and ``probability`` of class 1."""
    if model_name not in models:
        raise ValueError(f"no fitted model named {model_name!r}; fitted: {sorted(models)}")
    m = models[model_name]
    out = m.transform(df)
    return (out.withColumn("probability", vector_to_array("probability")[1])
            .withColumn("prediction", F.col("prediction").cast("int"))
            .drop("rawPrediction"))


def evaluate(models: dict, df: DataFrame, label: str = "label", split_col: str = "split",
             splits=("validation", "test")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ML9: class report, ROC-AUC and confusion per (model, split)."""
    reports, aucs, confs = [], [], []
    for name in models:
        scored = predict(models, df.filter(F.col(split_col).isin(*splits)), name)
        scored = scored.withColumn("model", F.lit(name)).persist()
        reports.append(M.class_report(scored, label, "prediction", ["model", split_col]))
        confs.append(M.confusion(scored, label, "prediction", ["model", split_col]))
        for sp in splits:
            aucs.append(M.roc_auc(scored.filter(F.col(split_col) == sp), label, "probability")
                        .withColumn("model", F.lit(name)).withColumn(split_col, F.lit(sp)))
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(union(xs[1:]))
    return union(reports), union(aucs), union(confs)
