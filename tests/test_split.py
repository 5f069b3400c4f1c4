"""Split sizes by largest remainder, and splits against a plain ranking."""

import hashlib
import math

from logsift.operators import split as SP


def test_sizes():
    assert SP.split_sizes({0: 100, 1: 2}) == {0: (21, 9), 1: (0, 0)}  # a class of two keeps both for training
    for counts in ({0: 7, 1: 3}, {0: 1, 1: 1}, {0: 0, 1: 0}, {0: 123456, 1: 789}, {1: 11}):
        sizes, n = SP.split_sizes(counts), sum(counts.values())
        test, val = (sum(s[k] for s in sizes.values()) for k in (0, 1))
        assert test == math.ceil(n / 5) and val == math.ceil((n - test) / 10)
        assert all(t + v <= counts[c] for c, (t, v) in sizes.items())


def test_split_equals_ranking(spark):
    rows = [(f"k{i}", 1 if i % 7 == 0 else 0) for i in range(400)] + [("none", None), ("other", 5)]
    got = {r["k"]: r["split"] for r in SP.stratified_split(spark.createDataFrame(rows, "k string, y int").repartition(5), "k", "y", rows_per_slice=30).collect()}
    sizes = SP.split_sizes({c: sum(y == c for _, y in rows) for c in (0, 1)})
    for c, (test, val) in sizes.items():
        keys = sorted((k for k, y in rows if y == c), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest()[:13])
        assert [got[k] for k in keys] == ["test"] * test + ["validation"] * val + ["train"] * (len(keys) - test - val)
    assert got["none"] is None and got["other"] is None
