"""Session helpers.

Only tests and local runs create a session here; on a cluster the caller's
session is used as is.  The checkpoint folder is read from the session
(``spark.checkpoint.dir``); a private folder is created only when it is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app_name: str = "logsift", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        # a small broadcast table takes one page of the heap, 64 MB by default with such a heap
        .config("spark.buffer.pageSize", "4m")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session.  Where it is unset, a local
    master gets a private temporary folder; on a cluster that folder would be on one
    machine's disk only, so a missing setting is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="logsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), name)


def staged(df, name: str):
    """Write ``df`` under the shared folder and read it back: cuts the lineage without a cache to release."""
    import uuid

    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``logsift`` importable in Python workers (pandas UDF stages).

    Zips the package once per SparkContext into the shared checkpoint folder
    and registers it with ``addPyFile``; a cluster deployment may instead
    pass the same zip with ``--py-files``."""
    import hashlib
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    if spark.conf.get("spark.logsift.shipPackage", "true").lower() == "false":
        return
    # a path without a scheme belongs to the default file system, which Hadoop names
    full = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark)).getFileSystem(
        sc._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark)))
    if full.toUri().getScheme() != "file":
        # cluster file system: deploy the package with --py-files instead
        _SHIPPED.add(key)
        return
    folder = full.toUri().getPath()
    os.makedirs(folder, exist_ok=True)
    pkg = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(r, f) for r, _, fs in os.walk(pkg) for f in fs if f.endswith(".py"))
    digest = hashlib.sha1()
    for f in files:
        with open(f, "rb") as fh:
            digest.update(f.encode() + fh.read())
    target = os.path.join(folder, f"logsift-{digest.hexdigest()[:12]}.zip")
    if not os.path.exists(target):
        tmp = target + f".{os.getpid()}.part"
        with zipfile.ZipFile(tmp, "w") as z:
            for f in files:
                z.write(f, os.path.join("logsift", os.path.relpath(f, pkg)))
        os.replace(tmp, target)
    sc.addPyFile(target)
    _SHIPPED.add(key)
