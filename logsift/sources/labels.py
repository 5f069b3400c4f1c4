"""Label CSV source (SC4) and label normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions import parse as P

LABEL_SCHEMA = "BlockId string, Label string"


def read_label_csv(spark: SparkSession, path: str | None) -> DataFrame:
    """Label CSV with header (BlockId, Label) and a file-order column ``_ord``.

    A missing path gives an empty DataFrame of the same schema (with a warning),
    as the original tool did.  The schema is given, never inferred."""
    empty = spark.createDataFrame([], LABEL_SCHEMA + ", _ord struct<f:string,b:long,i:long>")
    if not path:
        return empty
    try:
        df = spark.read.schema(LABEL_SCHEMA).option("header", True).csv(path)
        df = df.select("BlockId", "Label",
                       F.struct(F.col("_metadata.file_path").alias("f"),
                                F.col("_metadata.file_block_start").alias("b"),
                                F.monotonically_increasing_id().alias("i")).alias("_ord"))
        df.schema  # resolves the path now
        return df
    except Exception as exc:  # AnalysisException: path does not exist
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            print(f"no label file at {path}; all blocks count as unlabelled")
            return empty
        raise


def normalise_labels(rows: DataFrame, order_col: str | None = "_ord") -> DataFrame:
    """J2 + J3: key ``blk_`` -> ``block_``; duplicate keys keep the last row in
    file order (``max_by`` on the order struct; a partial aggregate, so a key
    repeated a billion times still spreads over tasks).

    Returns DataFrame[block_key, label]."""
    keyed = rows.withColumn("block_key", P.label_key(F.col("BlockId")))
    if order_col and order_col in rows.columns:
        return keyed.groupBy("block_key").agg(F.max_by("Label", order_col).alias("label"))
    return keyed.groupBy("block_key").agg(F.max("Label").alias("label"))


def read_labels(spark: SparkSession, path: str | None) -> DataFrame:
    return normalise_labels(read_label_csv(spark, path))
