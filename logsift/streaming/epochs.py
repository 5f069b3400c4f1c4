"""Tables that a stream fills epoch by epoch, each exactly once.

``foreachBatch`` may run an epoch again after a failure.  Here an epoch is a folder of its own: a folder
that was finished isn't written again, one that wasn't is written anew from the start.  Spark's success
file, written last, tells the two apart, and readers see finished epochs only.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from logsift.sources.io import path_exists


class EpochTable:
    """``path/delta/epoch=N``: the rows of epoch N; ``path/full/epoch=N``: all rows up to N, where compacted."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _folder(self, kind: str, epoch: int) -> str:
        return os.path.join(self.path, kind, f"epoch={epoch}")

    def done(self, epoch: int, kind: str = "delta") -> bool:
        return path_exists(self.spark, os.path.join(self._folder(kind, epoch), "_SUCCESS"))

    def epochs(self, kind: str = "delta") -> list[int]:
        """Finished epochs in order (one name per epoch comes to the driver)."""
        top = os.path.join(self.path, kind)
        if not path_exists(self.spark, top):
            return []
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        p = jvm.org.apache.hadoop.fs.Path(top)
        names = [f.getPath().getName() for f in p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]  # noqa: SLF001
        found = [int(m[1]) for n in names if (m := re.fullmatch(r"epoch=(\d+)", n))]
        return sorted(e for e in found if self.done(e, kind))

    def write(self, df: DataFrame, epoch: int, kind: str = "delta") -> bool:
        """Write an epoch unless it is there already; tells whether it wrote."""
        if self.done(epoch, kind):
            return False
        df.write.mode("overwrite").parquet(self._folder(kind, epoch))
        return True

    def read(self, upto: int | None = None) -> DataFrame:
        """Rows of all finished epochs (up to one of them), with their ``epoch``; compacted ones carry their last epoch."""
        keep = lambda e: upto is None or e <= upto
        full = [e for e in self.epochs("full") if keep(e)][-1:]
        delta = [e for e in self.epochs() if keep(e) and (not full or e > full[0])]
        out = self.spark.createDataFrame([], f"{self.schema}, epoch long")
        for kind, chosen in (("full", full), ("delta", delta)):
            if chosen:
                base = os.path.join(self.path, kind)
                rows = (self.spark.read.schema(f"{self.schema}, epoch long").option("basePath", base)
                        .parquet(*[self._folder(kind, e) for e in chosen]))
                out = out.unionByName(rows)
        return out

    def compact(self, epoch: int) -> bool:
        """Write all rows up to ``epoch`` as one table, so that later reads open few files."""
        return self.write(self.read(epoch).drop("epoch"), epoch, "full")
