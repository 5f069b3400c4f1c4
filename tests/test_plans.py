"""Plan checks: no nested-loop or cartesian joins on line-level data."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as E

from conftest import SF001

BAD = ("BroadcastNestedLoopJoin", "CartesianProduct")


@pytest.mark.parametrize("key", ["parse_logs", "block_sequences", "time_windows", "count_windows",
                                 "tfidf", "stratified_split", "roc_auc", "evaluate_windows",
                                 "sequence_logs"])
def test_no_nested_loop_joins(spark, key):
    df = E.queries()[key](spark, SF001)
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    plan = buf.getvalue()
    assert not [b for b in BAD if b in plan], plan[:2000]


def test_scan_prunes_columns(spark):
    df = E.queries()["block_sequences"](spark, SF001)
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    plan = buf.getvalue()
    # the events scan reads only the columns the log fixture needs (not `value`)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in plan
