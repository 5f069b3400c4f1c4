"""Parse edge cases (hand-made lines) and the text reader's file order."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from logsift.sources import logs as G
from logsift.sources.labels import normalise_labels, read_labels


def _parse(spark, lines, **kw):
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    return {r["line_no"]: r for r in G.parse_lines(df, **kw).collect()}


def test_line_layout_and_invalid_times(spark):
    got = _parse(spark, [
        "081109 203518 143 INFO dfs.DataNode$DataXceiver: Receiving block blk_-1608 src: /10.0.0.1",
        "   ",
        "malformed line",
        "131109 203518 1 INFO c: x",          # month 13
        "023009 203518 1 INFO c: x",          # Feb 30
        "081109 240000 1 INFO c: x",          # hour 24
        "081109 235960 1 INFO c: x",          # second 60
        "081109 203518 1 INFO a:b: x",        # component a, then ':b' -> no match
        "081109 203518 123456789012345678901 INFO c: blk_1 and blk_2",
        "  081109 203518 7 WARN c: padded  \r",
    ])
    r = got[0]
    assert (r["level"], r["component"], r["block_id"]) == ("INFO", "dfs.DataNode$DataXceiver", "-1608")
    assert r["message"] == "Receiving block blk_-1608 src: /10.0.0.1"
    assert r["timestamp"] == dt.datetime(2008, 8, 11, 20, 35, 18, 143000)
    assert 1 not in got and 2 not in got and 7 not in got
    assert all(got[i]["timestamp"] is None for i in (3, 4, 5, 6))
    assert got[8]["timestamp"] == dt.datetime(2008, 8, 11, 20, 35, 18, 999000)  # clamped
    assert got[8]["block_id"] == "1"                                              # first id only
    assert got[9]["raw_line"] == "081109 203518 7 WARN c: padded"


def test_all_blocks_and_yymmdd(spark):
    df = spark.createDataFrame([(0, "081109 203518 5 INFO c: blk_1 then blk_-2")], "line_no long, value string")
    ids = sorted(r["block_id"] for r in G.parse_lines(df, all_blocks=True).collect())
    assert ids == ["-2", "1"]
    r = G.parse_lines(df, date_layout="yymmdd").first()
    assert r["timestamp"] == dt.datetime(2008, 11, 9, 20, 35, 18) and r["field3"] == 5


def test_read_log_text_file_order_and_bytes(spark):
    d = tempfile.mkdtemp(prefix="logsift-text-")
    with open(os.path.join(d, "a.log"), "wb") as fh:
        fh.write(b"081109 203518 1 INFO c: first\r\n081109 203518 2 INFO c: bad\xff byte\n")
    with open(os.path.join(d, "b.log"), "wb") as fh:
        fh.write(b"081109 203518 3 INFO c: third\r081109 203518 4 INFO c: fourth\n")
    lines = G.read_log_text(spark, d)
    rows = sorted((r["line_no"], r["value"]) for r in lines.collect())
    assert [n for n, _ in rows] == [0, 1, 2, 3]
    parsed = G.parse_lines(lines).orderBy("line_no").collect()
    assert [p["message"] for p in parsed] == ["first", "bad byte", "third", "fourth"]
    assert G.read_log_text(spark, d, max_lines=3).count() == 3


def test_labels_last_row_wins_and_missing_file(spark):
    d = tempfile.mkdtemp(prefix="logsift-labels-")
    p = os.path.join(d, "labels.csv")
    with open(p, "w") as fh:
        fh.write("BlockId,Label\nblk_1,Normal\nblk_2,Anomaly\nblk_1,Anomaly\nblk_3,Odd\n")
    got = {r["block_key"]: r["label"] for r in read_labels(spark, p).collect()}
    assert got == {"block_1": "Anomaly", "block_2": "Anomaly", "block_3": "Odd"}
    assert read_labels(spark, os.path.join(d, "missing.csv")).count() == 0


def test_parse_stats_counts(spark):
    df = spark.createDataFrame(list(enumerate(["", "x", "081109 203518 1 INFO c: blk_9 m",
                                                "131109 203518 1 INFO c: m"])),
                               "line_no long, value string")
    parsed = G.parse_logs(df, templates="fixture")
    s = G.parse_stats(df, parsed).first()
    assert (s["total_lines"], s["parsed_lines"], s["valid_timestamps"], s["with_block_id"]) == (4, 2, 1, 1)


def test_empty_input(spark):
    df = spark.createDataFrame([], "line_no long, value string")
    assert G.parse_lines(df).count() == 0
