"""Streaming operators: pieces of hot windows, template mining by new patterns, scores written once per epoch."""

import os
import shutil
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from logsift.operators import iforest as IF
from logsift.plans import queries as R
from logsift.plans.runs import window_features
from logsift.streaming import stream as ST
from logsift.streaming.epochs import EpochTable

from conftest import SF001


def _write(lines, n_files):
    d = tempfile.mkdtemp(prefix="logsift-stream-in-")
    per = len(lines) // n_files + 1
    for i in range(n_files):
        with open(os.path.join(d, f"part{i}.log"), "w") as fh:
            fh.write("\n".join(lines[i * per:(i + 1) * per]) + "\n")
    return d


def _write_lines(spark, n_files=3):
    return _write([r["value"] for r in R.X.log_lines(spark, SF001).orderBy("line_no").collect()], n_files)


def _folders(spark):
    return R._stream_folders(spark, "test")


def _parsed(spark, folder):
    return ST.parse_stream(ST.read_text_stream(spark, folder, max_files_per_trigger=1))


def test_template_ids_across_batches(spark):
    query, miner = ST.mine_template_stream(_parsed(spark, _write_lines(spark)), *_folders(spark))
    query.awaitTermination()
    res = miner.lines.read()
    batch = R.parsed_fixture(spark, SF001)
    assert res.count() == batch.count()            # every parsed line gets an id
    # same fixture kinds as the batch miner: 6 templates, stable across the 3 batches
    assert res.select("template_id").distinct().count() == 6
    assert len(miner.lines.epochs()) == 3


def _log(i, message):
    return f"081109 2036{i % 60:02d} {i % 900} INFO dfs.X: {message}"


def test_a_hot_leaf_meets_python_as_its_new_patterns(spark, monkeypatch):
    """A third of all lines lies in one leaf; only its patterns, each once, are matched."""
    lines = [_log(i, f"put key v{i} as {'alpha' if i % 2 else 'beta'} now done") for i in range(1500)]
    lines += [_log(i, f"event {chr(97 + i % 20)}x happened once") for i in range(3000)]
    folder = _write(lines, 3)
    seen = []
    kept = ST.TemplateMiner.new_patterns

    def counted(self, keyed, epoch):
        new = kept(self, keyed, epoch)
        seen.append(new.count())
        return new

    monkeypatch.setattr(ST.TemplateMiner, "new_patterns", counted)
    monkeypatch.setattr(ST, "COMPACT_EVERY", 2)
    query, miner = ST.mine_template_stream(_parsed(spark, folder), *_folders(spark))
    query.awaitTermination()
    assert sum(seen) == 22 and miner.lines.read().count() == 4500 and miner.patterns.epochs("full") == [2]
    by = {r.template_str: r.n for r in miner.lines.read().groupBy("template_str").agg(F.count("*").alias("n")).collect()}
    assert sum(n for t, n in by.items() if t.startswith("put key <*> as")) == 1500
    assert miner.lines.read().filter("template_str like 'put%'").select("template_id").distinct().count() == 1
    assert sorted(r.pattern for r in miner.patterns.read().collect()) == sorted(
        [f"put key <*> as {x} now done" for x in ("alpha", "beta")] + [f"event {chr(97 + k)}x happened once" for k in range(20)])


def test_a_third_of_all_lines_in_one_window_stays_in_pieces(spark):
    lines = [_log(0, "burst of equal lines")] * 1000  # one instant, one text
    lines += [f"081109 {h:02d}{m:02d}00 1 INFO dfs.X: line {h} {m}" for h in range(20) for m in range(0, 60)] * 2
    folder = _write(lines, 3)
    ST.write_end_marker(spark, folder)
    parsed = _parsed(spark, folder).withColumn("template_id", F.length("message"))
    pieces = R._drain(spark, ST.window_piece_stream(parsed, "3600 seconds", watermark="1 day", pieces=8), "hot")
    hot = pieces.filter("start_time = timestamp_ntz'2008-08-11 20:00:00'")
    n = [r.n for r in hot.collect()]
    assert sum(n) == 1000 and len(n) == 8 and max(n) < 200
    rows = ST.window_rows(pieces)
    out = ST.assembled(ST.ordered_pieces(rows, ["window_id"], 300), ["window_id"])
    assert {r.length for r in out.collect()} == {1000, 120} and out.count() == 21
    assert ST.closed_windows(pieces).filter("log_count = 1000").first().unique_templates == 1


def test_sessions_hold_bounds_only(spark):
    lines = [f"081109 {h:02d}{m:02d}{s:02d} 5 INFO dfs.X: got blk_7 x" for h, m in ((1, 0), (1, 4), (9, 0)) for s in range(0, 60, 2)]
    folder = _write(lines, 2)
    ST.write_end_marker(spark, folder)
    parsed = _parsed(spark, folder).withColumn("template_id", F.lit(4))
    bounds = R._drain(spark, ST.block_session_bounds(parsed, "5 minutes", watermark="1 day"), "sb")
    rows = R._drain(spark, ST.block_rows(parsed), "sr")
    got = sorted(r.length for r in bounds.filter("block_id = '7'").collect())
    assert got == [30, 60] and "items" not in bounds.columns
    per = ST.session_rows(bounds, rows).filter("block_id = '7'").groupBy("start_us").count()
    assert sorted(r["count"] for r in per.collect()) == got


def _forest_run(spark, folder, sink, checkpoint):
    o = R.ordered_fixture(spark, SF001)
    _, _, ft, fm, n = window_features(o, 20, 0, 50)
    forest = IF.fit_isolation_forest(ft, "window_id", fm.size, n_trees=10, n_rows=n)
    parsed = _parsed(spark, folder).withColumn("template_id", R.X.fixture_template_id())
    pieces = ST.window_piece_stream(parsed, "3600 seconds", watermark="2 days")

    def run():
        query, table = ST.score_closed_windows(pieces, ST.forest_scorer(fm, forest), sink, checkpoint)
        query.awaitTermination()
        return table

    return run


def test_scores_of_a_replayed_epoch_are_written_once(spark):
    folder = _write_lines(spark)
    ST.write_end_marker(spark, folder)  # closes the last windows
    sink, checkpoint = _folders(spark)
    run = _forest_run(spark, folder, sink, checkpoint)
    table = run()
    rows = lambda: sorted(tuple(r) for r in table.read().collect())
    first = rows()
    assert first and all(-1 <= r[4] <= 0 for r in first) and len({r[0] for r in first}) == len(first)
    last = max(int(f) for f in os.listdir(os.path.join(checkpoint, "commits")) if f.isdigit())
    # the stream fails after it wrote the last epoch, and after it wrote half of it
    for half in (False, True):
        os.remove(os.path.join(checkpoint, "commits", str(last)))
        crc = os.path.join(checkpoint, "commits", f".{last}.crc")
        if os.path.exists(crc):
            os.remove(crc)
        if half:
            os.remove(os.path.join(sink, "delta", f"epoch={last}", "_SUCCESS"))
            assert max(table.epochs()) < last  # readers don't see it
        run()
        assert rows() == first and max(table.epochs()) == last
    with pytest.raises(ValueError):  # a new checkpoint would number its epochs from 0 again
        ST.score_closed_windows(ST.window_piece_stream(_parsed(spark, folder).withColumn("template_id", F.lit(1)), watermark="1 day"),
                                lambda w, p: w, sink, checkpoint + "-other")


def test_epoch_table(spark, tmp_path):
    t = EpochTable(spark, str(tmp_path / uuid.uuid4().hex), "x int")
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "x int")
    assert t.read().count() == 0 and t.write(df(1, 2), 0) and t.write(df(3), 1) and not t.write(df(9), 1)
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, 0), (2, 0), (3, 1)]
    assert sorted(r.x for r in t.read(0).collect()) == [1, 2]
    assert t.compact(1) and t.write(df(4), 2)
    shutil.rmtree(os.path.join(t.path, "delta", "epoch=0"))  # compacted epochs aren't read any more
    assert sorted(r.x for r in t.read().collect()) == [1, 2, 3, 4] and sorted(r.x for r in t.read(1).collect()) == [1, 2, 3]
