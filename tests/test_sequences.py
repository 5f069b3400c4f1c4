"""Sequences and windows: slice-count invariance, loop oracle, edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logsift.operators import features as FT
from logsift.operators import sequences as Q
from logsift.plans import queries as R
from logsift.sources import logs as G

from conftest import SF01


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def parsed(spark):
    return R.parsed_fixture(spark, SF01).persist()


def test_block_sequences_slice_invariant(spark, parsed):
    a = Q.block_sequences(Q.order_logs(parsed))
    b = Q.block_sequences(Q.order_logs(parsed, rows_per_slice=97))
    cols = ["seq_id", "template_sequence", "length", "start_time", "end_time", "time_span"]
    assert _rows(a, cols) == _rows(b, cols)


def test_count_and_time_windows_slice_invariant(spark, parsed):
    o1, o2 = Q.order_logs(parsed), Q.order_logs(parsed, rows_per_slice=131)
    cols = ["window_id", "start_idx", "end_idx", "template_sequence", "log_count", "start_time"]
    assert _rows(Q.count_windows(o1, 100, 30), cols) == _rows(Q.count_windows(o2, 100, 30), cols)
    tcols = ["seq_id", "template_sequence", "length", "start_time"]
    assert (_rows(Q.time_windows(o1, 3600, 1800), tcols)
            == _rows(Q.time_windows(o2, 3600, 1800), tcols))


def test_ngrams_across_pieces(spark, parsed):
    o1, o2 = Q.order_logs(parsed), Q.order_logs(parsed, rows_per_slice=53)
    t1 = FT.ngram_terms(Q.block_pieces(o1), ["seq_id"], (1, 3))
    t2 = FT.ngram_terms(Q.block_pieces(o2), ["seq_id"], (1, 3))
    assert _rows(t1, ["seq_id", "term", "tf"]) == _rows(t2, ["seq_id", "term", "tf"])


def _loop_time_windows(ts, size, overlap):
    """Straight re-statement of the original window loop (seconds as floats)."""
    ts = sorted(ts)
    out, cur, step = [], ts[0], size - overlap
    while cur < ts[-1]:
        members = [t for t in ts if cur <= t < cur + size]
        if members:
            out.append((cur, len(members)))
        cur += step
    return out


def _loop_count_windows(n, size, overlap):
    out = []
    for i in range(0, n, size - overlap):
        e = min(i + size, n)
        if e - i >= size // 2:
            out.append((i, e))
    return out


def _logs_df(spark, stamps):
    base = dt.datetime(2008, 1, 1)
    rows = [(i, base + dt.timedelta(microseconds=int(s * 1e6)), "b", i % 5) for i, s in enumerate(stamps)]
    return spark.createDataFrame(rows, "line_no long, timestamp timestamp_ntz, block_id string, template_id int")


@pytest.mark.parametrize("size,overlap", [(60, 0), (60, 30), (50, 12), (7, 6)])
def test_time_windows_loop_oracle(spark, size, overlap):
    rnd = random.Random(size * 100 + overlap)
    stamps = [rnd.randrange(0, 600) for _ in range(120)] + [0, 600, 540]  # boundary hits
    o = Q.order_logs(_logs_df(spark, stamps), rows_per_slice=16)
    got = sorted((r["start_time"], r["length"]) for r in Q.time_windows(o, size, overlap).collect())
    base = dt.datetime(2008, 1, 1)
    want = [(base + dt.timedelta(seconds=c), n) for c, n in _loop_time_windows(stamps, size, overlap)]
    assert got == want


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (8, 7), (6, -4), (1, 0)])
def test_count_windows_loop_oracle(spark, size, overlap):
    stamps = [i // 3 for i in range(53)]  # ties everywhere
    o = Q.order_logs(_logs_df(spark, stamps), rows_per_slice=5)
    got = sorted((r["start_idx"], r["end_idx"]) for r in Q.count_windows(o, size, overlap).collect())
    assert got == _loop_count_windows(53, size, overlap)


def test_overlap_not_smaller_than_size_raises(spark, parsed):
    o = Q.order_logs(parsed)
    with pytest.raises(ValueError):
        Q.time_windows(o, 60, 60)
    with pytest.raises(ValueError):
        Q.count_windows(o, 10, 12)


def test_single_instant_has_no_time_window(spark):
    o = Q.order_logs(_logs_df(spark, [5, 5, 5]))
    assert Q.time_windows(o, 60, 0).count() == 0


def test_single_log_block_span_zero(spark):
    o = Q.order_logs(_logs_df(spark, [7]))
    r = Q.block_sequences(o).first()
    assert r["length"] == 1 and r["time_span"] == 0.0


def test_hot_block_is_split_into_bounded_pieces(spark):
    """One block holds a third of all rows: pieces stay bounded, results equal."""
    base = dt.datetime(2008, 1, 1)
    rnd = random.Random(9)
    rows = []
    for i in range(900):
        blk = "hot" if i % 3 == 0 else f"b{i % 40}"
        rows.append((i, base + dt.timedelta(seconds=rnd.randrange(0, 5000)), blk, rnd.randrange(1, 6)))
    df = spark.createDataFrame(rows, "line_no long, timestamp timestamp_ntz, block_id string, template_id int")
    small = Q.order_logs(df, rows_per_slice=50)
    pieces = Q.block_pieces(small)
    biggest = pieces.agg(F.max("n")).first()[0]
    assert biggest <= 3 * 50
    assert pieces.filter(F.col("seq_id") == "block_hot").count() > 3
    cols = ["seq_id", "template_sequence", "length", "start_time", "end_time"]
    assert _rows(Q.block_sequences(small), cols) == _rows(Q.block_sequences(Q.order_logs(df)), cols)
    want = [t for _, _, b, t in sorted((r for r in rows if r[2] == "hot"), key=lambda r: (r[1], r[0]))]
    got = Q.block_sequences(small).filter(F.col("seq_id") == "block_hot").first()["template_sequence"]
    assert got == want
