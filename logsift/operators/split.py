"""Stratified train / validation / test split by hashing (ML1).

Each row gets a uniform value from ``md5(seed | key)`` (first 13 hex digits,
exact in a double; md5 gives the same value in every engine).  Inside each class
the lowest values go to test, the next to validation, the rest to train.

Sizes come from one total: ``ceil(test_size * n)`` rows are shared among the classes
in proportion, by largest remainder (ties: the larger class, then the smaller
label), and ``ceil(validation_size * rest)`` of what is left likewise, so a small
class keeps its training rows.  Only the class counts and two cut values per class
reach the driver; the split itself is a narrow expression with those cuts as
literals, and full rows are never shuffled.  Rows that share a key share a hash, hence a split.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.operators import order as O

_TWO52 = float(1 << 52)


def hash_uniform(key_col: str, seed: int = 42) -> F.Column:
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key_col).cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(_TWO52)


def allocate(total: int, sizes: dict) -> dict:
    """Share ``total`` in proportion to ``sizes`` by largest remainder."""
    n = sum(sizes.values())
    if not n:
        return {c: 0 for c in sizes}
    exact = {c: Fraction(total * k, n) for c, k in sizes.items()}
    out = {c: int(x) for c, x in exact.items()}
    for c in sorted(sizes, key=lambda c: (out[c] - exact[c], -sizes[c], c))[:total - sum(out.values())]:
        out[c] += 1
    return out


def split_sizes(counts: dict, test_size: float = 0.2, validation_size: float = 0.1) -> dict:
    """{class: (test rows, validation rows)}."""
    n = sum(counts.values())
    test = allocate(ceil(Fraction(str(test_size)) * n), counts)
    rest = {c: k - test[c] for c, k in counts.items()}
    val = allocate(ceil(Fraction(str(validation_size)) * sum(rest.values())), rest)
    return {c: (test[c], val[c]) for c in counts}


def stratified_split(df: DataFrame, key_col: str, label_col: str, test_size: float = 0.2,
                     validation_size: float = 0.1, seed: int = 42,
                     rows_per_slice: int = O.BRACKET_ROWS) -> DataFrame:
    """Adds ``split`` in {train, validation, test}.  Labels must be 0/1 (rows
    with other labels get ``split`` NULL)."""
    y = F.col(label_col).cast("int")
    u = hash_uniform(key_col, seed)
    narrow = df.filter(y.isin(0, 1)).select(y.alias("_y"), u.alias("_u")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = {r["_y"]: r["n"] for r in narrow.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
        split = F.when(~F.coalesce(y.isin(0, 1), F.lit(False)), F.lit(None).cast("string"))
        for c, (test, val) in split_sizes(counts, test_size, validation_size).items():
            # the rows below a cut are the first ones by hash
            _, got = O.order_statistics(narrow.filter(F.col("_y") == c), "_u", [test - 1, test + val - 1], rows_per_slice)
            if test:
                split = split.when((y == c) & (u <= F.lit(got[test - 1])), "test")
            if val:
                split = split.when((y == c) & (u <= F.lit(got[test + val - 1])), "validation")
        return df.withColumn("split", split.otherwise("train"))
    finally:
        narrow.unpersist()
