"""Sequences stored in pieces of bounded size, and back."""

import pytest
from pyspark.sql import functions as F

from logsift.operators import sequences as Q
from logsift.plans import queries as R
from logsift.sources import io as IO

from conftest import SF001

HEADER = "seq_id string, type string, id string, length long, start_time timestamp_ntz, end_time timestamp_ntz, time_span double"


@pytest.fixture(scope="module")
def hot(spark):
    """One block that holds more than half of all rows."""
    parsed = R.parsed_fixture(spark, SF001).withColumn("block_id", F.when(F.col("line_no") % 5 < 3, F.lit("7")).otherwise(F.col("block_id")))
    return Q.order_logs(parsed, rows_per_slice=60)


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_round_trip_of_a_hot_block(spark, hot, tmp_path, fmt):
    stored = Q.stored_pieces(Q.block_pieces(hot), ["seq_id"], 25)
    assert stored.agg(F.max(F.size("ids"))).first()[0] == 25
    IO.save_pieces(Q.block_headers(hot), stored, str(tmp_path), fmt)
    headers, pieces = IO.load_pieces(spark, str(tmp_path), HEADER, fmt)
    want = {r.seq_id: r for r in Q.block_sequences(hot).collect()}
    got = {r.seq_id: r for r in Q.whole_sequences(headers, pieces).collect()}
    assert want.keys() == got.keys() and want["block_7"].length > 500
    for k, r in want.items():
        assert [getattr(r, c) for c in ("id", "type", "template_sequence", "length", "start_time", "end_time", "time_span")] == [
            getattr(got[k], c) for c in ("id", "type", "template_sequence", "length", "start_time", "end_time", "time_span")]
    assert all(r.first_position == r.piece * 25 for r in pieces.collect())


def test_pieces_don_t_depend_on_slices(spark, hot):
    other = Q.order_logs(hot.full.drop(Q.TS_US), rows_per_slice=400)
    table = lambda o: sorted((r.seq_id, r.piece, tuple(r.ids)) for r in Q.stored_pieces(Q.block_pieces(o), ["seq_id"], 25).collect())
    assert table(hot) == table(other)


def test_wrong_format_and_missing_columns(spark, hot, tmp_path):
    with pytest.raises(ValueError):
        IO.load_pieces(spark, str(tmp_path), HEADER, "xml")
    IO.save_pieces(Q.block_headers(hot).drop("time_span"), Q.stored_pieces(Q.block_pieces(hot), ["seq_id"]), str(tmp_path))
    with pytest.raises(ValueError):
        IO.load_pieces(spark, str(tmp_path), HEADER)
