"""Sinks (SK1-SK5) and dataset loaders (SC5, SC6).

Everything goes through Spark's writers and readers, so outputs are
directories of part files on the shared file system.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions import parse as P

FORMATS = ("csv", "json", "parquet")
# The columns that the data set files must have.
BLOCK_REQUIRED = ["block_id", "sequence_length", "template_sequence_str", "time_span",
                  "anomaly_binary_val"]
WINDOW_REQUIRED = ["window_id", "template_sequence_str", "log_count", "time_span"]


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the data set lacks the columns {missing}")
    return df


def _flat_for_csv(df: DataFrame) -> DataFrame:
    """CSV cannot hold arrays: comma-join int arrays (dropping them when a
    ``*_str`` twin already exists), other complex columns as JSON text."""
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            if f"{f.name}_str" in df.columns:
                out = out.drop(f.name)
            else:
                out = out.withColumn(f.name, F.to_json(F.col(f.name)))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            out = out.withColumn(f.name, F.to_json(F.col(f.name)))
    return out


def save_dataset(df: DataFrame, path: str, format: str = "csv", mode: str = "overwrite") -> str:
    """SK1 / SK2: write a dataset; CSV with a header, JSON one object per line,
    timestamps in ISO-8601.  Unknown format -> ``ValueError``."""
    fmt = format.lower()
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format: {format}")
    w = (_flat_for_csv(df) if fmt == "csv" else df).write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    elif fmt == "json":
        w.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    else:
        w.parquet(path)
    return path


BLOCK_CSV_SCHEMA = ("block_id string, sequence_length int, template_sequence_str string, "
                    "start_time timestamp_ntz, end_time timestamp_ntz, time_span double, "
                    "anomaly_binary_val int, anomaly_labels string, anomaly_label int")
WINDOW_CSV_SCHEMA = ("window_id string, start_idx long, end_idx long, start_time timestamp_ntz, "
                     "end_time timestamp_ntz, time_span double, log_count int, "
                     "template_sequence_str string, unique_templates int")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (works for
    cluster file systems, not only local disks)."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def _load(spark: SparkSession, path: str, csv_schema: str, required: list[str]) -> DataFrame:
    """Format by extension, as the original loaders did (a Spark output
    directory named ``x.csv`` / ``x.parquet`` counts)."""
    p = path.rstrip("/")
    if p.endswith(".csv"):
        df = (spark.read.schema(csv_schema).option("header", True)
              .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))
    elif p.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif p.endswith(".json"):
        df = spark.read.schema(csv_schema).json(path)
    else:
        raise ValueError(f"Unsupported file format: {path}")
    require_columns(df, required)
    if "template_sequence" not in df.columns:
        df = df.withColumn("template_sequence", P.string_to_ids(F.col("template_sequence_str")))
    return df


def load_block_data(spark: SparkSession, path: str) -> DataFrame:
    """SC5: block dataset from CSV / JSON / parquet, required columns checked."""
    return _load(spark, path, BLOCK_CSV_SCHEMA, BLOCK_REQUIRED)


def load_window_data(spark: SparkSession, path: str) -> DataFrame:
    """SC6: window dataset; ``unique_templates`` is derived when absent."""
    df = _load(spark, path, WINDOW_CSV_SCHEMA, WINDOW_REQUIRED)
    derived = F.size(F.array_distinct("template_sequence"))
    if "unique_templates" in df.columns:
        return df.withColumn("unique_templates", F.coalesce(F.col("unique_templates"), derived))
    return df.withColumn("unique_templates", derived)


# -- data sets in pieces: rows of bounded size ------------------------------------------

PIECE_CSV_SCHEMA = "{key} string, piece long, first_position long, ids {ids}"


def save_pieces(headers: DataFrame, stored: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> str:
    """SK1 for sequences of any length: ``path``/headers and ``path``/pieces (``stored_pieces``), each a data set of ``format``."""
    fmt = format.lower()
    save_dataset(headers, os.path.join(path, f"headers.{fmt}"), fmt, mode)
    save_dataset(stored, os.path.join(path, f"pieces.{fmt}"), fmt, mode)
    return path


def load_pieces(spark: SparkSession, path: str, header_schema: str, format: str = "parquet", key: str = "seq_id") -> tuple[DataFrame, DataFrame]:
    """SC5 for such a data set: (headers, pieces).  ``header_schema`` types the headers of CSV and JSON files."""
    fmt = format.lower()
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported file format: {format}")
    iso = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

    def read(name, schema):
        r = spark.read.options(**iso) if fmt != "parquet" else spark.read
        r = r.option("header", True) if fmt == "csv" else r
        return (r.schema(schema) if fmt != "parquet" else r).format(fmt).load(os.path.join(path, f"{name}.{fmt}"))

    pieces = read("pieces", PIECE_CSV_SCHEMA.format(key=key, ids="string" if fmt == "csv" else "array<int>"))
    if fmt == "csv":
        pieces = pieces.withColumn("ids", F.from_json("ids", "array<int>"))
    headers = read("headers", header_schema)
    names = [f.name for f in T.StructType.fromDDL(header_schema).fields]
    return require_columns(headers, names), require_columns(pieces, [key, "piece", "first_position", "ids"])


# -- models (SK4 / SK5) ------------------------------------------------------------

def save_models(spark: SparkSession, save_dir: str, feature_model=None, models: dict | None = None,
                forest=None, covariance=None, stats: dict | None = None) -> str:
    """Vocabulary, scaler, Spark ML models, forest nodes, robust covariance, feature names, stats."""
    from logsift.operators.features import FeatureModel  # noqa: F401  (type of feature_model)

    def small(df_pd: pd.DataFrame, name: str, schema: str | None = None):
        sdf = spark.createDataFrame(df_pd, schema) if schema else spark.createDataFrame(df_pd)
        sdf.coalesce(1).write.mode("overwrite").parquet(os.path.join(save_dir, name))

    if feature_model is not None:
        fm = feature_model
        small(pd.DataFrame({"term": fm.tfidf.terms, "feature_idx": range(fm.tfidf.size),
                            "doc_freq": fm.tfidf.doc_freq, "idf": fm.tfidf.idf}), "tfidf_vocabulary",
              "term string, feature_idx long, doc_freq long, idf double")
        small(pd.DataFrame({"column": fm.scaler.columns, "mean": fm.scaler.mean,
                            "scale": fm.scaler.scale}), "metadata_scaler",
              "column string, mean double, scale double")
        small(pd.DataFrame({"n_docs": [fm.tfidf.n_docs], "ngram_lo": [fm.ngram_range[0]],
                            "ngram_hi": [fm.ngram_range[1]]}), "feature_params",
              "n_docs long, ngram_lo int, ngram_hi int")
        small(pd.DataFrame({"position": range(len(fm.names)), "name": fm.names}), "feature_names",
              "position long, name string")
    for name, m in (models or {}).items():
        m.write().overwrite().save(os.path.join(save_dir, f"{name}_model"))
    if forest is not None:
        small(forest.nodes, "isolation_forest_nodes",
              "tree int, node int, feature int, threshold double, left int, right int, "
              "size long, depth int")
        small(pd.DataFrame({"psi": [forest.psi], "n_trees": [forest.n_trees], "dim": [forest.dim],
                            "contamination": [float(forest.contamination)],
                            "offset": [forest.offset]}), "isolation_forest_params",
              "psi long, n_trees long, dim long, contamination double, offset double")
    if covariance is not None:
        m = covariance
        small(pd.DataFrame({"column": m.columns, "location": m.location, "raw_location": m.raw_location,
                            "covariance": m.covariance.tolist(), "raw_covariance": m.raw_covariance.tolist(),
                            "precision": m.precision.tolist(), "position": range(len(m.columns)),
                            "offset": [m.offset] * len(m.columns)}), "robust_covariance",
              "column string, location double, raw_location double, covariance array<double>, "
              "raw_covariance array<double>, precision array<double>, position long, offset double")
    if stats:
        small(pd.DataFrame({"key": list(stats), "value": [str(v) for v in stats.values()]}),
              "training_stats", "key string, value string")
    return save_dir


def load_models(spark: SparkSession, save_dir: str) -> dict:
    """Inverse of ``save_models``; missing names / stats are tolerated."""
    from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel

    from logsift.operators.features import FeatureModel, ScalerModel, TfidfModel
    from logsift.operators.iforest import IsolationForestModel

    def read(name):  # small parameter tables only (vocabulary, scaler, forest nodes)
        p = os.path.join(save_dir, name)
        return spark.read.parquet(p).toPandas() if path_exists(spark, p) else None

    out: dict = {"models": {}}
    vocab, scaler, params = read("tfidf_vocabulary"), read("metadata_scaler"), read("feature_params")
    if vocab is not None and scaler is not None and params is not None:
        vocab = vocab.sort_values("feature_idx")
        tf = TfidfModel(list(vocab["term"]), [int(x) for x in vocab["doc_freq"]],
                        int(params["n_docs"][0]), [float(x) for x in vocab["idf"]])
        sc = ScalerModel(list(scaler["column"]), [float(x) for x in scaler["mean"]],
                         [float(x) for x in scaler["scale"]])
        out["feature_model"] = FeatureModel(tf, sc, (int(params["ngram_lo"][0]),
                                                     int(params["ngram_hi"][0])))
    loaders = {"logistic_regression": LogisticRegressionModel, "boosted_trees": GBTClassificationModel}
    for name, cls in loaders.items():
        p = os.path.join(save_dir, f"{name}_model")
        if path_exists(spark, p):
            out["models"][name] = cls.load(p)
    nodes, fp = read("isolation_forest_nodes"), read("isolation_forest_params")
    if nodes is not None and fp is not None:
        off = fp["offset"][0]
        out["forest"] = IsolationForestModel(nodes, int(fp["psi"][0]), int(fp["n_trees"][0]),
                                             int(fp["dim"][0]), float(fp["contamination"][0]),
                                             None if pd.isna(off) else float(off))
    cov = read("robust_covariance")
    if cov is not None:
        import numpy as np

        from logsift.operators.robust_cov import RobustCovModel
        cov = cov.sort_values("position")
        square = lambda c: np.array([list(x) for x in cov[c]])
        off = cov["offset"].iloc[0]
        out["covariance"] = RobustCovModel(list(cov["column"]), cov["location"].to_numpy(), square("covariance"),
                                           cov["raw_location"].to_numpy(), square("raw_covariance"), [],
                                           None if pd.isna(off) else float(off), square("precision"))
    names, stats = read("feature_names"), read("training_stats")
    if names is None or stats is None:
        print(f"{save_dir}: saved without feature names or training statistics")
    out["feature_names"] = [] if names is None else list(names.sort_values("position")["name"])
    out["stats"] = {} if stats is None else dict(zip(stats["key"], stats["value"]))
    return out
