"""Invariance: shuffle-partition count and input split size do not change results."""

import os
import tempfile

from logsift.operators import sequences as Q
from logsift.plans import queries as R
from logsift.sources import logs as G

from conftest import SF001


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_shuffle_partitions_invariance(spark):
    cols = ["seq_id", "template_sequence", "length", "time_span"]
    wcols = ["window_id", "template_sequence", "start_idx"]
    out = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            o = R.ordered_fixture(spark, SF001, rows_per_slice=101)
            out.append((_rows(Q.block_sequences(o), cols), _rows(Q.count_windows(o, 20, 5), wcols)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]


def test_many_small_splits_keep_file_order(spark):
    d = tempfile.mkdtemp(prefix="logsift-splits-")
    expect = []
    for name in ("a.log", "b.log"):
        with open(os.path.join(d, name), "w") as fh:
            for i in range(1500):
                line = f"081109 2035{i % 60:02d} {i} INFO c: {name} line {i}"
                fh.write(line + "\n")
                expect.append(line)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        lines = G.read_log_text(spark, d)
        assert lines.rdd.getNumPartitions() > 10
        got = [r["value"] for r in lines.orderBy("line_no").collect()]
        nums = sorted(r["line_no"] for r in lines.select("line_no").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == expect
    assert nums == list(range(3000))
