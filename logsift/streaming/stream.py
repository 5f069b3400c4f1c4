"""Structured Streaming forms of the log operators (ST1-ST5).

The original tool only read finished files; these re-aim its operators at a
stream:

* ST1 ``parse_stream``: the batch parse expressions applied to a streaming
  DataFrame of lines (stateless, shared code).
* ST2 ``window_piece_stream``: event-time tumbling / sliding windows with a
  watermark, which the caller must choose: rows later than it are dropped, and
  ``late_rows`` tells how many were.  A window's lines are collected in pieces, so that a
  burst window is many rows of state and never one; ``assembled`` makes one ordered row per window of
  closed pieces where that is wanted (``window_stream`` does so inside the state, for windows known to be small).
  A finished input closes its last windows with ``write_end_marker``.  Windows are anchored at the epoch -- a
  stream has no known minimum -- a stated difference from the batch operator, which anchors at the first log.
* ST3 ``block_session_bounds``: a block's session closes after ``gap`` of inactivity; the state holds its
  bounds and length only.  ``session_rows`` joins closed sessions with the lines, which a second, stateless query
  writes (``block_session_stream``: one row with the whole sequence in the state, for small sessions).
* ST4 ``mine_template_stream``: online template mining.  Each micro-batch is reduced to its distinct patterns
  first; only patterns never seen before meet the leaf's templates, and lines get their ids by a join on the
  pattern.  The state is a table of (leaf, pattern, ordinal), an epoch's new rows at a time.
* ST5 ``score_closed_windows``: closed windows scored by a fitted model, an epoch at a time.

ST4 and ST5 write ``EpochTable``s: an epoch that runs again after a failure changes nothing.

Every query needs a checkpoint location on the shared file system; the
helpers derive it from the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions import parse as P
from logsift.operators import order as O
from logsift.operators import sequences as Q
from logsift.operators.templates import WILDCARD, masked_tokens
from logsift.session import checkpoint_dir, ship_package
from logsift.sources.io import path_exists
from logsift.sources.logs import parse_lines
from logsift.streaming.epochs import EpochTable


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", name)


# -- ST1 ---------------------------------------------------------------------------

def parse_stream(lines: DataFrame, date_layout: str = "reference") -> DataFrame:
    """Streaming parse.  ``lines`` needs ``value`` and a ``line_no`` tie-break
    (``read_text_stream`` adds one)."""
    return parse_lines(lines, date_layout=date_layout)


def read_text_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None):
    """Text files arriving in ``path`` as DataFrame[line_no, value].

    Streams have no row index for text, so ``line_no`` is a hash of the line's
    text: a deterministic tie-break for equal timestamps, not file order (a stated
    difference from the batch reader).  Equal lines share it; they hold the same
    time and message, so their order among themselves shows nowhere."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.load(path)
    return df.select(text_key(F.col("value")).alias("line_no"), "value")


def text_key(value) -> F.Column:
    """60 bits of the line's md5 as a long (the same in every engine)."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


END_MARKER = "123124 235959 999 INFO end: of input blk_0"


def write_end_marker(spark: SparkSession, path: str) -> None:
    """Add a last file whose one line lies at the end of the layout's year.

    It moves the watermark past every window and session of the input, so all of them close;
    its own window stays open and is never emitted.  For finite inputs only: call it when no more
    files will come, and use a watermark that covers the disorder of the input."""
    spark.createDataFrame([(END_MARKER,)], "value string").coalesce(1).write.mode("append").text(path)


def late_rows(query) -> int:
    """Rows that a finished or running query has dropped as later than its watermark."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in (p["stateOperators"] if isinstance(p, dict) else json.loads(p.json)["stateOperators"]))


# -- ST2 / ST3 ---------------------------------------------------------------------

EVENT_TIME = "event_time"


def with_event_time(parsed: DataFrame) -> DataFrame:
    """Watermarks need a TIMESTAMP column: the parsed wall-clock time read in
    the session time zone (run streams with ``spark.sql.session.timeZone=UTC``)."""
    return (parsed.filter(F.col("timestamp").isNotNull())
            .withColumn(EVENT_TIME, F.col("timestamp").cast("timestamp")))


PIECE_SCHEMA = "start_time timestamp_ntz, end_time timestamp_ntz, piece int, items array<struct<timestamp:timestamp_ntz,line_no:bigint,value:int>>, n bigint"


def window_piece_stream(parsed: DataFrame, window_size: str = "60 seconds", slide: str | None = None, *,
                        watermark: str, value_col: str = "template_id", pieces: int = 16) -> DataFrame:
    """Each window's lines in up to ``pieces`` rows: (start_time, end_time, piece, items, n).

    Emitted once the watermark passes the window end, all pieces of a window in the same epoch.
    Lines are dealt to the pieces by a seeded draw, which a rerun of a task repeats, so lines that are all alike spread as well.
    ``watermark``: how far a line may lag behind the latest one; later lines are lost."""
    w = F.window(EVENT_TIME, window_size, slide) if slide else F.window(EVENT_TIME, window_size)
    dealt = with_event_time(parsed).withColumn("piece", F.floor(F.rand(11) * pieces).cast("int"))
    agg = (dealt.withWatermark(EVENT_TIME, watermark).groupBy(w.alias("window"), "piece")
           .agg(F.sort_array(F.collect_list(F.struct("timestamp", "line_no", F.col(value_col).cast("int").alias("value")))).alias("items"),
                F.count(F.lit(1)).alias("n")))
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("start_time"),
                      F.col("window.end").cast("timestamp_ntz").alias("end_time"), "piece", "items", "n")


def window_rows(pieces: DataFrame) -> DataFrame:
    """A row per line and window: window_id, the columns of the batch order (``_ts_us``, line_no), template_id."""
    return (pieces.select(F.concat(F.lit("stream_"), P.epoch_micros(F.col("start_time")).cast("string")).alias("window_id"), F.explode("items").alias("x"))
            .select("window_id", P.epoch_micros(F.col("x.timestamp")).alias(Q.TS_US), F.col("x.line_no").alias("line_no"), F.col("x.value").alias("template_id")))


def ordered_pieces(rows: DataFrame, keys: list[str], rows_per_slice: int = O.ROWS_PER_SLICE) -> DataFrame:
    """The batch piece table of streamed rows: (keys, slice, ids, n), slices in time order and of bounded size."""
    # lines that are all alike share line_no (60 bits of a hash): the sample goes by the row's place in the written table,
    # and a hot instant is cut by ranges of the hash
    placed = rows.withColumn("_place", F.monotonically_increasing_id()).withColumn("_tie", (F.col("line_no") - F.lit(1 << 59)) * 16)
    plan = O.plan_slices(placed, Q.TS_US, "_place", rows_per_slice, n_rows=rows.count(), tie_kind="hash")
    return Q.sequence_pieces(O.with_slices(placed, plan, Q.TS_US, "_tie"), keys)


def assembled(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sequence, (keys, template_sequence, length), from ``ordered_pieces``: on request only, as the row is
    as large as its sequence."""
    return ordered.groupBy(*keys).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(O.B, O.S, "ids"))), lambda s: s["ids"])).alias("template_sequence"),
        F.sum("n").alias("length"))


def window_stream(parsed: DataFrame, window_size: str = "60 seconds", slide: str | None = None, *,
                  watermark: str, value_col: str = "template_id") -> DataFrame:
    """Windowed template sequences, emitted once the watermark passes the window end.

    ``watermark``: how far a line may lag behind the latest one; later lines are lost."""
    w = F.window(EVENT_TIME, window_size, slide) if slide else F.window(EVENT_TIME, window_size)
    agg = (with_event_time(parsed)
           .withWatermark(EVENT_TIME, watermark)
           .groupBy(w.alias("window"))
           .agg(F.sort_array(F.collect_list(F.struct("timestamp", "line_no", value_col))).alias("_it"),
                F.count(F.lit(1)).alias("length")))
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("start_time"),
                      F.col("window.end").cast("timestamp_ntz").alias("end_time"),
                      F.col(f"_it.{value_col}").alias("template_sequence"), "length")


def block_session_bounds(parsed: DataFrame, gap: str = "5 minutes", *, watermark: str) -> DataFrame:
    """(block_id, start_time, end_time, length) of sessions that ``gap`` without a log of the block has closed.

    A hot block's session is one small row of state; its lines combine before the shuffle where
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is true."""
    agg = (with_event_time(parsed.filter(F.col("block_id").isNotNull())).withWatermark(EVENT_TIME, watermark)
           .groupBy("block_id", F.session_window(EVENT_TIME, gap).alias("session"))
           .agg(F.count(F.lit(1)).alias("length"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time")))
    return agg.select("block_id", "start_time", "end_time", "length")


def block_rows(parsed: DataFrame, value_col: str = "template_id") -> DataFrame:
    """What a stateless query keeps of each block line for ``session_rows``."""
    return parsed.filter(F.col("block_id").isNotNull() & F.col("timestamp").isNotNull()).select(
        "block_id", P.epoch_micros(F.col("timestamp")).alias(Q.TS_US), "line_no", F.col(value_col).cast("int").alias("template_id"))


def session_rows(bounds: DataFrame, rows: DataFrame) -> DataFrame:
    """Lines of closed sessions: (block_id, start_us, ``_ts_us``, line_no, template_id).

    A block's sessions don't overlap, so a line finds its own by the block and the last start at or before it.  The
    join is on the block; a block with a third of all lines is split by AQE."""
    b = bounds.select("block_id", P.epoch_micros(F.col("start_time")).alias("start_us"), P.epoch_micros(F.col("end_time")).alias("end_us"))
    return rows.join(b, [rows["block_id"] == b["block_id"], F.col(Q.TS_US).between(F.col("start_us"), F.col("end_us"))]).select(
        rows["block_id"], "start_us", Q.TS_US, "line_no", "template_id")


def block_session_stream(parsed: DataFrame, gap: str = "5 minutes", *, watermark: str,
                         value_col: str = "template_id") -> DataFrame:
    """Block sequences that close after ``gap`` without a new log of the block."""
    agg = (with_event_time(parsed.filter(F.col("block_id").isNotNull()))
           .withWatermark(EVENT_TIME, watermark)
           .groupBy("block_id", F.session_window(EVENT_TIME, gap).alias("session"))
           .agg(F.sort_array(F.collect_list(F.struct("timestamp", "line_no", value_col))).alias("_it"),
                F.count(F.lit(1)).alias("length"),
                F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time")))
    return agg.select(F.concat(F.lit("block_"), F.col("block_id")).alias("seq_id"), "block_id",
                      F.col(f"_it.{value_col}").alias("template_sequence"), "length",
                      "start_time", "end_time",
                      P.seconds_between(F.col("start_time"), F.col("end_time")).alias("time_span"))


# -- ST4 ---------------------------------------------------------------------------

def _similarity(template: list[str], tokens: list[str]) -> tuple[float, int]:
    sim = params = 0
    for a, b in zip(template, tokens):
        if a == WILDCARD:
            params += 1
        elif a == b:
            sim += 1
    return sim / max(1, len(template)), params


def _merge(template: list[str], tokens: list[str]) -> list[str]:
    return [a if a == b else WILDCARD for a, b in zip(template, tokens)]


PATTERN_SCHEMA = "leaf string, pattern string, ordinal int"
TEMPLATE_SCHEMA = "line_no long, template_id long, template_str string"
#: Epochs after which the pattern table is written whole.
COMPACT_EVERY = 50


def _assigner(sim_threshold: float):
    """Per leaf: new patterns, in the order of their first lines, join the most similar template or open one."""
    def assign(new: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        templates: list[list[str]] = []
        for pattern, ordinal in known.sort_values("ordinal")[["pattern", "ordinal"]].itertuples(index=False):
            tokens = pattern.split(" ")
            if ordinal == len(templates):
                templates.append(tokens)
            else:
                templates[ordinal] = _merge(templates[ordinal], tokens)
        new = new.sort_values(["first", "pattern"])
        found = []
        for pattern in new["pattern"]:
            tokens = pattern.split(" ")
            best, best_key = -1, None
            for ci, tpl in enumerate(templates):
                s, p = _similarity(tpl, tokens)
                if s >= sim_threshold and (best_key is None or (s, p) > best_key):
                    best, best_key = ci, (s, p)
            if best < 0:
                templates.append(tokens)
                best = len(templates) - 1
            else:
                templates[best] = _merge(templates[best], tokens)
            found.append(best)
        return pd.DataFrame({"leaf": new["leaf"], "pattern": new["pattern"], "ordinal": found})

    return assign


def template_texts(patterns: DataFrame) -> DataFrame:
    """(leaf, ordinal, template_str): a template keeps the tokens that all its patterns share at a position."""
    tokens = patterns.select("leaf", "ordinal", F.posexplode(F.split("pattern", " ")).alias("pos", "token"))
    kept = tokens.groupBy("leaf", "ordinal", "pos").agg(
        F.when(F.min("token") == F.max("token"), F.min("token")).otherwise(F.lit(WILDCARD)).alias("t"))
    return kept.groupBy("leaf", "ordinal").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), " ").alias("template_str"))


class TemplateMiner:
    """Tables of a template stream below ``path``: known patterns, and the lines' templates."""

    def __init__(self, spark: SparkSession, path: str, text_col: str = "message", sim_threshold: float = 0.4, prefix_tokens: int = 2):
        self.patterns = EpochTable(spark, os.path.join(path, "patterns"), PATTERN_SCHEMA)
        self.lines = EpochTable(spark, os.path.join(path, "lines"), TEMPLATE_SCHEMA)
        self.text_col, self.sim_threshold, self.prefix_tokens = text_col, sim_threshold, prefix_tokens
        ship_package(spark)

    def new_patterns(self, keyed: DataFrame, epoch: int) -> DataFrame:
        """Distinct patterns of a batch that no earlier epoch had: (leaf, pattern, first), counted before any shuffle of lines."""
        known = self.patterns.read(epoch - 1)
        batch = keyed.groupBy("leaf", "pattern").agg(F.min("line_no").alias("first"))
        return batch.join(known.select("leaf", "pattern"), ["leaf", "pattern"], "left_anti")

    def step(self, parsed: DataFrame, epoch: int) -> None:
        """One micro-batch.  What an epoch has written before a failure is read back, not decided again."""
        if self.lines.done(epoch):
            return
        tok = masked_tokens(F.col(self.text_col))
        leaf = F.concat_ws("\u0001", F.size("_tok").cast("string"), F.array_join(F.slice("_tok", 1, self.prefix_tokens), "\u0001"))
        keyed = parsed.withColumn("_tok", tok).select("line_no", leaf.alias("leaf"), F.array_join("_tok", " ").alias("pattern")).persist(
            StorageLevel.MEMORY_AND_DISK)
        if not self.patterns.done(epoch):
            new = self.new_patterns(keyed, epoch)
            old = self.patterns.read(epoch - 1).select("leaf", "pattern", "ordinal").join(new.select("leaf").distinct(), "leaf", "left_semi")
            self.patterns.write(new.groupBy("leaf").cogroup(old.groupBy("leaf")).applyInPandas(_assigner(self.sim_threshold), PATTERN_SCHEMA), epoch)
        if epoch and epoch % COMPACT_EVERY == 0:
            self.patterns.compact(epoch)
        known = self.patterns.read(epoch).drop("epoch")
        ids = known.join(keyed.select("leaf", "pattern").distinct(), ["leaf", "pattern"], "left_semi")
        members = known.join(ids.select("leaf", "ordinal").distinct(), ["leaf", "ordinal"], "left_semi")
        table = ids.join(template_texts(members), ["leaf", "ordinal"])
        # a stable id: hash of the leaf and the template's place in it
        self.lines.write(keyed.join(table, ["leaf", "pattern"]).select(
            "line_no", F.xxhash64("leaf", "ordinal").alias("template_id"), "template_str"), epoch)
        keyed.unpersist()


def _start(stream: DataFrame, step: Callable[[DataFrame, int], None], tables: list[EpochTable], checkpoint: str, trigger_once: bool):
    """Run ``step`` per epoch.  Epochs are numbered by the checkpoint, so its tables belong to it alone."""
    spark = stream.sparkSession
    if any(t.epochs() for t in tables) and not path_exists(spark, os.path.join(checkpoint, "commits")):
        raise ValueError("the output tables belong to another checkpoint")
    q = stream.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if trigger_once else q).start()


def mine_template_stream(parsed: DataFrame, path: str, checkpoint: str, trigger_once: bool = True, **options):
    """(query, miner): template ids of a stream's lines, in ``miner.lines`` (line_no, template_id, template_str).

    The text is that of the template when the line's epoch ended.  Patterns of an epoch are taken in the order of
    their first lines, so ids don't depend on the order within it.  A leaf's lines meet Python as new patterns
    only; a leaf with a third of all lines costs no more there than its patterns."""
    miner = TemplateMiner(parsed.sparkSession, path, **options)
    return _start(parsed, miner.step, [miner.patterns, miner.lines], checkpoint, trigger_once), miner


# -- ST5 ---------------------------------------------------------------------------

SCORE_SCHEMA = "window_id string, start_time timestamp_ntz, end_time timestamp_ntz, log_count long, anomaly_score double, is_anomaly int"


def closed_windows(pieces: DataFrame) -> DataFrame:
    """(window_id, start_time, end_time, log_count, time_span, unique_templates) of the windows in ``pieces``.

    Distinct templates are counted from the pieces' distinct ids, so no row holds a whole window."""
    key = F.concat(F.lit("stream_"), P.epoch_micros(F.col("start_time")).cast("string")).alias("window_id")
    p = pieces.select(key, "start_time", "end_time", "n", F.array_distinct(F.col("items.value")).alias("ids"))
    totals = p.groupBy("window_id", "start_time", "end_time").agg(F.sum("n").alias("log_count"))
    kinds = p.select("window_id", F.explode("ids").alias("id")).groupBy("window_id").agg(F.count_distinct("id").cast("int").alias("unique_templates"))
    return totals.join(kinds, "window_id").withColumn("time_span", P.seconds_between(F.col("start_time"), F.col("end_time")))


def forest_scorer(feature_model, forest) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Scores windows by all their text and metadata features with a fitted isolation forest."""
    from logsift.operators import features as FT

    def score(windows: DataFrame, pieces: DataFrame) -> DataFrame:
        ft = FT.feature_table(windows, ordered_pieces(window_rows(pieces), ["window_id"]), "window_id", feature_model)
        scored = forest.score(ft, "window_id")
        return forest.predict(scored) if forest.offset is not None else scored.withColumn("is_anomaly", F.lit(None).cast("int"))

    return score


def score_closed_windows(pieces: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], sink_path: str,
                         checkpoint: str, trigger_once: bool = True):
    """(query, table): windows of ``window_piece_stream`` scored as they close, an ``EpochTable`` of ``SCORE_SCHEMA``.

    ``score(windows, pieces)`` gives (window_id, anomaly_score, is_anomaly) for the closed windows; it runs per epoch."""
    spark = pieces.sparkSession
    table = EpochTable(spark, sink_path, SCORE_SCHEMA)
    ship_package(spark)

    def step(df: DataFrame, epoch: int) -> None:
        if table.done(epoch):
            df.write.format("noop").mode("overwrite").save()  # the window state has to advance all the same
            return
        held = df.persist(StorageLevel.MEMORY_AND_DISK)  # the state advances once per epoch, whatever reads it
        windows = closed_windows(held)
        scored = score(windows, held).select("window_id", "anomaly_score", "is_anomaly")
        table.write(windows.join(scored, "window_id").select("window_id", "start_time", "end_time", "log_count", "anomaly_score", "is_anomaly"), epoch)
        held.unpersist()

    return _start(pieces, step, [table], checkpoint, trigger_once), table


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, output_mode: str = "append"):
    """Drain a streaming DataFrame into parquet with an available-now trigger."""
    q = (df.writeStream.outputMode(output_mode).format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q

