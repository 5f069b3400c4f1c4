"""Integer vectors in cells: a block of queries meets a block of all rows, and cells' best lists merge.

The rows are cut into blocks of bounded bytes, and so are the queries, which are a stated set.  A cell is
one block of each.  Every cell is a group of its own, so no task holds more than two blocks, and a lost
executor costs the cells that it held.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Bytes of one block of vectors, and rows from which a table is cut to keep all cores busy.
BLOCK_BYTES, SMALL_BLOCK = 16 << 20, 4096
#: Cells whose lists meet in one merge.
FAN = 256


def integer_rows(df: DataFrame, scale: int, name: str, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """(id, vec array of long, label if given) of the rows that take part, as a written table.

    A row with a null id, a null label, a null vector, or a null or non-finite component takes no part.
    Component x becomes floor(scale * x), x as double, held within 64 bits."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    used = F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~bad
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    out = [F.col(vec_id).cast("long").alias("id"), whole.alias("vec")]
    if label is not None:
        used, out = used & label.isNotNull(), [*out, label.cast("long").alias("label")]
    return stage(df.filter(used).select(*out), name)


class Grid:
    """How a table of integer rows and its queries are cut into cells."""

    def __init__(self, rows: DataFrame, is_query: Column):
        self.rows = rows
        keep = [c for c in rows.columns if c != "id"]
        # a query id that several rows carry is one query, the least of them by (label, vector)
        self.queries = stage(rows.filter(is_query).groupBy("id").agg(F.min(F.struct(*sorted(keep))).alias("r")).select(
            "id", *[F.col(f"r.{c}").alias(c) for c in keep]), "queries")
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("vec")).alias("d")).first()
        self.dim = max(n["d"] or 0, 1)
        most = max(BLOCK_BYTES // (8 * self.dim), 1)
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = max(ceil(n["n"] / most), min(parts, ceil(n["n"] / SMALL_BLOCK)), 1)
        self.query_blocks = max(ceil(n["q"] / most), 1)

    def apply(self, queries: DataFrame, step, schema: str) -> DataFrame:
        """``step(queries table, rows table)`` for each cell, with the column ``cell``: its block of rows.

        A row's block hangs on its place in the written table, which a rerun of a task reads alike, so
        rows that repeat an id spread over the blocks."""
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(self.blocks)).cast("int")
        rows = self.rows.withColumn("cell", place).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.query_blocks - 1))))
        asked = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(self.query_blocks)).cast("int")).withColumn(
            "cell", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return out.empty_table()
            found = step(left, right)
            at = pa.array(np.full(found.num_rows, right["cell"][0].as_py(), np.int32))
            return found.append_column("cell", at).select(out.names).cast(out)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        kinds = StructType.fromDDL(f"{schema}, cell int")
        out = to_arrow_schema(kinds)
        return asked.groupBy("part", "cell").cogroup(rows.groupBy("part", "cell")).applyInArrow(cell, kinds)

    def merge(self, lists: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
        """The first ``k`` of each key over all cells, numbered from 1; at most ``FAN`` lists meet at a time."""
        cells = self.blocks
        while cells > FAN:
            cells = ceil(cells / FAN)
            lists = lists.withColumn("cell", F.floor(F.col("cell") / FAN).cast("int"))
            near = Window.partitionBy(*keys, "cell").orderBy(*order)
            lists = lists.withColumn(rank, F.row_number().over(near)).filter(F.col(rank) <= k).drop(rank)
        return lists.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of ``dim`` longs; a shorter vector ends in zeros."""
    at, out = 0, np.zeros((len(vectors), dim), np.int64)
    for part in vectors.chunks:
        n = len(part)
        sizes = np.diff(part.offsets.to_numpy())
        values = part.flatten().to_numpy()
        if (sizes == dim).all():
            out[at:at + n] = values.reshape(n, dim)
        else:
            out[at:at + n][np.arange(dim) < sizes[:, None]] = values
        at += n
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by ascending id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]
