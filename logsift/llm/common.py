"""Helpers shared by the operators: row keys, shared tables, components, ranges."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.session import scratch_path

#: The white space of the word and normalisation rules.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back.

    The table replaces the lineage: a lost executor costs a reread, and no recomputed
    task can see other values than the first run did."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stage`` table that no later plan reads."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_row_key(docs: DataFrame, row: str, key: str = "doc_id") -> DataFrame:
    """Add a unique, non-null long ``row`` that ascends with ``key`` (nulls last).

    Unique keys of an integer type serve as they are.  Otherwise (repeated or null keys, text, fractions) the rows are
    written once in key order and numbered, so that repeated rows stay apart and a rerun of a task sees the same numbers."""
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    bad = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
    if whole and not bad.limit(1).count():
        return docs.withColumn(row, F.col(key).cast("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in docs.columns if c != key and dict(docs.dtypes)[c] in ("string", "bigint", "int", "double")]
    order = [F.col(f"`{key}`").asc_nulls_last(), *[F.col(f"`{c}`").asc_nulls_last() for c in rest]]
    spread = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stage(spread.withColumn(row, F.monotonically_increasing_id()), "rows")


def normalised(text: str | Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE, " ")


def range_points(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending split points of a long column (pinned: the same on every retry)."""
    if parts < 2:
        return []
    got = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts).alias("p")).first()["p"]
    return sorted(set(got or []))


def bucket_of(points: list[int]):
    """A function of a long column: the number of split points at or below it (binary search, by Arrow batch)."""
    at = np.array(points, np.int64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, key.to_numpy(np.int64), "right").astype(np.int32))

    return bucket


def even_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` buckets a long whose hash partition is the bucket's own, so that
    ``repartition(parts, key)`` puts one bucket into each partition."""
    got = (spark.range(parts * (20 + parts.bit_length() * 2)).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p"))
           .groupBy("p").agg(F.min("id").alias("id")).collect())  # one number per partition
    key = {r["p"]: r["id"] for r in got}
    return [key.get(p, p) for p in range(parts)]


#: Rows of a few numbers (16 to 40 bytes) that may be broadcast.
MAX_BROADCAST = 1_000_000
#: Edges of ``components`` that a task takes, so that few edges aren't dealt over hundreds of files.
PER_TASK = 1 << 17


def small(rows: DataFrame) -> DataFrame:
    """``rows``, for a broadcast where they are few enough, so that a join with them shuffles nothing."""
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST else rows


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node id reachable from each node that has an edge: (node, root).

    ``edges`` has long columns u, v and is read several times: a written table.  Large-star and
    small-star rounds rewire edges to the smallest neighbour, or to that one's; each round is two
    grouped minima, which are broadcast where they are few and joined otherwise, so a hub's edges
    spread over tasks.  The nodes and edges of each round are written to the shared folder.  Rounds end
    when the edges are stars: every node has one node below it or only nodes above.  No edge reaches the driver."""
    cur, written = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), []
    tasks = -(-cur.count() // PER_TASK) or 1  # no round has more edges than the one before
    for _ in range(max_rounds + 1):
        ends = cur.select(F.col("u").alias("node"), F.col("v").alias("end")).unionAll(cur.select(F.col("v").alias("node"), F.col("u").alias("end")))
        nodes = stage(ends.groupBy("node").agg(F.least(F.min("end"), "node").alias("root"), F.max("end").alias("most")).coalesce(tasks), "nodes")
        n = nodes.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("root") < F.least("node", "most"), 1)).alias("open")).first()
        if not n["open"]:
            for old in written:
                discard(old)
            return nodes.select("node", "root")
        held = (lambda x: F.broadcast(x.coalesce(tasks))) if n["all"] <= MAX_BROADCAST else lambda x: x
        low = nodes.join(held(nodes.select(F.col("node").alias("root"), F.col("root").alias("m"))), "root").select(F.col("node").alias("v"), "m")
        large = cur.join(held(low), "v").select("u", F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        cur = stage(large.join(held(low), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks), "edges")
        for old in written:
            discard(old)
        written = [nodes, cur]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def slices(batch, column: str, max_bytes: int = 8 << 20):
    """Cut an Arrow batch into runs of rows whose ``column`` holds about ``max_bytes`` (one row at least)."""
    import pyarrow.compute as pc

    n = batch.num_rows
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        limit = (ends[at - 1] if at else 0) + max_bytes
        to = max(at + 1, int(np.searchsorted(ends, limit, "right")))
        yield batch.slice(at, to - at)
        at = to
