"""Sequences: per block (A1), per time window (W2/A2), per count window.

Events of a sequence are ordered by (timestamp, file order).  Arrays are built
in two stages: first one sorted *piece* per (sequence, order slice) -- a piece
holds at most one slice of rows, so a hot block or a burst window is spread
over many tasks -- then the pieces of a sequence are concatenated in slice
order.  Lengths, bounds and spans are plain partial aggregates.  Only the
``template_sequence`` array itself is as large as its sequence (it is the
output); feature operators work on the pieces and never need it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions import parse as P
from logsift.operators import order as O

TS_US = "_ts_us"
# The leading columns of the log tables, in order.
PRIORITY_COLUMNS = ["timestamp", "level", "component", "message", "block_id", "sequence_id",
                    "raw_line"]


ORDER_COLUMNS = ["line_no", "timestamp", TS_US, "block_id", "template_id"]


@dataclass
class OrderedLogs:
    """Logs with a valid timestamp: a narrow persisted copy with the key column
    and order slices (``df``), the full rows (``full``) and a slice plan."""
    df: DataFrame          # ORDER_COLUMNS + _sb/_ss (persisted, ~30 bytes a row)
    plan: O.SlicePlan
    n_rows: int
    min_us: int | None
    max_us: int | None
    cached: DataFrame | None = None
    full: DataFrame | None = None  # every parsed column + _ts_us (not persisted here)

    def release(self) -> None:
        """Drop the persisted copy of the valid logs."""
        if self.cached is not None:
            self.cached.unpersist()


def order_logs(parsed: DataFrame, rows_per_slice: int = O.ROWS_PER_SLICE) -> OrderedLogs:
    """Keep logs with a timestamp (PF5), add the epoch-µs key and order slices.

    Actions: one aggregate (count, min, max) and the slice sample.  ``parsed``
    should be persisted (or written) by the caller since several operators and
    the planning actions read it.
    """
    full = (parsed.filter(F.col("timestamp").isNotNull())
            .withColumn(TS_US, P.epoch_micros(F.col("timestamp"))))
    valid = full.select(*ORDER_COLUMNS).persist(StorageLevel.MEMORY_AND_DISK)
    st = valid.agg(F.count(F.lit(1)).alias("n"), F.min(TS_US).alias("lo"),
                   F.max(TS_US).alias("hi")).first()
    plan = O.plan_slices(valid, TS_US, "line_no", rows_per_slice, n_rows=st["n"])
    sliced = O.with_slices(valid, plan, TS_US, "line_no")
    return OrderedLogs(sliced, plan, st["n"], st["lo"], st["hi"], valid, full)


def _pieces(df: DataFrame, seq_cols: list[str], value_col: str = "template_id") -> DataFrame:
    """One sorted piece per (sequence, slice): items ordered by (ts, line_no)."""
    return (df.groupBy(*seq_cols, O.B, O.S)
            .agg(F.sort_array(F.collect_list(F.struct(TS_US, "line_no", value_col))).alias("_items"),
                 F.count(F.lit(1)).alias("_n"),
                 F.min(TS_US).alias("_lo"), F.max(TS_US).alias("_hi")))


def sequence_pieces(df: DataFrame, seq_cols: list[str], value_col: str = "template_id") -> DataFrame:
    """Public piece table: (seq cols, _sb, _ss, ids array, n).  Used by n-gram features."""
    return (_pieces(df, seq_cols, value_col)
            .select(*seq_cols, O.B, O.S, F.col(f"_items.{value_col}").alias("ids"),
                    F.col("_n").alias("n")))


def _assemble(pieces: DataFrame, seq_cols: list[str], value_col: str = "template_id") -> DataFrame:
    """Concatenate pieces in slice order; totals from partial aggregates."""
    return (pieces.groupBy(*seq_cols)
            .agg(F.flatten(F.transform(
                    F.sort_array(F.collect_list(F.struct(O.B, O.S, F.col(f"_items.{value_col}")
                                                         .alias("v")))),
                    lambda s: s["v"])).alias("template_sequence"),
                 F.sum("_n").alias("length"),
                 F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")))


def _ts(us_col) -> F.Column:
    return F.timestamp_add("MICROSECOND", us_col, F.expr(P.EPOCH_NTZ))


def block_sequences(ordered: OrderedLogs) -> DataFrame:
    """A1: one row per block id with its ordered template ids.

    Columns: seq_id (``block_<id>``), type, id, template_sequence, length,
    start_time, end_time, time_span (seconds; 0 for a single log)."""
    logs = ordered.df.filter(F.col("block_id").isNotNull())  # PF4
    seqs = _assemble(_pieces(logs, ["block_id"]), ["block_id"])
    return seqs.select(
        F.concat(F.lit("block_"), F.col("block_id")).alias("seq_id"),
        F.lit("block").alias("type"),
        F.col("block_id").alias("id"),
        "template_sequence", "length",
        _ts(F.col("_lo")).alias("start_time"), _ts(F.col("_hi")).alias("end_time"),
        ((F.col("_hi") - F.col("_lo")) / F.lit(1e6)).alias("time_span"))


def _check_step(size, overlap) -> int:
    step = size - overlap
    if step <= 0:
        raise ValueError(f"overlap ({overlap}) must be smaller than window size ({size})")
    return step


def time_window_membership(ordered: OrderedLogs, window_size_seconds: int = 60,
                           overlap_seconds: int = 0, rows: DataFrame | None = None) -> DataFrame:
    """(log row, window index k) for every window that holds the log.

    Windows start at min_ts + k*step while the start is before max_ts and are
    half-open [start, start + size).  Index range per row by arithmetic, then
    ``explode(sequence(lo, hi))``: rows grow by size/step at most, no join."""
    step = _check_step(window_size_seconds, overlap_seconds)
    src = ordered.df if rows is None else rows
    if ordered.n_rows == 0:
        return src.withColumn("_k", F.lit(None).cast("long")).limit(0)
    Z, S = int(window_size_seconds * 1_000_000), int(step * 1_000_000)
    lo_us, span = ordered.min_us, ordered.max_us - ordered.min_us
    o = F.col(TS_US) - F.lit(lo_us)
    hi = F.floor(o / F.lit(S))
    lo = F.when(o < F.lit(Z), F.lit(0)).otherwise(F.floor((o - F.lit(Z)) / F.lit(S)) + 1)
    # last usable index: k*S < span
    kmax = (span - 1) // S if span > 0 else -1
    hi = F.least(hi, F.lit(kmax))
    return (src.withColumn("_klo", lo.cast("long")).withColumn("_khi", hi.cast("long"))
            .filter(F.col("_klo") <= F.col("_khi"))
            .withColumn("_k", F.explode(F.sequence("_klo", "_khi")))
            .drop("_klo", "_khi"))


def time_windows(ordered: OrderedLogs, window_size_seconds: int = 60,
                 overlap_seconds: int = 0, membership: DataFrame | None = None) -> DataFrame:
    """A2: one row per non-empty time window, numbered consecutively.

    Columns: seq_id (``time_<id>``), type, id, template_sequence, length,
    start_time / end_time (window bounds, W5), window_size."""
    step = _check_step(window_size_seconds, overlap_seconds)
    mem = membership if membership is not None else time_window_membership(
        ordered, window_size_seconds, overlap_seconds)
    seqs = _assemble(_pieces(mem, ["_k"]), ["_k"])
    ids = O.dense_ids(mem, "_k", "id")  # arithmetic on the cached time column, then distinct
    Z, S = int(window_size_seconds * 1_000_000), int(step * 1_000_000)
    start = F.lit(ordered.min_us if ordered.min_us is not None else 0) + F.col("_k") * F.lit(S)
    return (seqs.join(ids, "_k")
            .select(F.concat(F.lit("time_"), F.col("id").cast("string")).alias("seq_id"),
                    F.lit("time_window").alias("type"),
                    F.col("id").cast("int").alias("id"),
                    "template_sequence", "length",
                    _ts(start).alias("start_time"), _ts(start + F.lit(Z)).alias("end_time"),
                    F.lit(window_size_seconds).alias("window_size")))


def count_window_membership(positions: DataFrame, n_rows: int, window_size: int = 100,
                            overlap: int = 0) -> DataFrame:
    """(log row with ``pos``, window index j) with step = size - overlap."""
    step = _check_step(window_size, overlap)
    p = F.col("pos")
    hi = F.least(F.floor(p / F.lit(step)), F.lit((max(n_rows, 1) - 1) // step))
    lo = F.when(p - F.lit(window_size) + 1 <= 0, F.lit(0)).otherwise(
        F.floor((p - F.lit(window_size) + F.lit(step)) / F.lit(step)))
    return (positions.withColumn("_jlo", lo.cast("long")).withColumn("_jhi", hi.cast("long"))
            .filter(F.col("_jlo") <= F.col("_jhi"))
            .withColumn("_j", F.explode(F.sequence("_jlo", "_jhi")))
            .drop("_jlo", "_jhi"))


def log_positions(ordered: OrderedLogs) -> DataFrame:
    """Global 0-based position in (timestamp, file order)."""
    return O.global_position(ordered.df.drop(O.B, O.S), TS_US, "line_no", "pos",
                             plan=ordered.plan)


def count_windows(ordered: OrderedLogs, window_size: int = 100, overlap: int = 0,
                  positions: DataFrame | None = None) -> DataFrame:
    """A3: fixed-count windows over the globally ordered logs.

    A window holds at most ``window_size`` rows, so its array is bounded.
    Windows shorter than ``window_size div 2`` are dropped (PF7); they can only
    be trailing, so ``window_<j>`` numbering stays consecutive."""
    step = _check_step(window_size, overlap)
    n = ordered.n_rows
    pos = positions if positions is not None else log_positions(ordered)
    mem = count_window_membership(pos, n, window_size, overlap)
    g = (mem.groupBy("_j")
         .agg(F.sort_array(F.collect_list(F.struct("pos", TS_US, "template_id"))).alias("_it"),
              F.count(F.lit(1)).alias("log_count")))
    first, last = F.element_at("_it", 1), F.element_at("_it", -1)
    ids = F.col("_it.template_id")
    return (g.filter(F.col("log_count") >= F.lit(window_size // 2))
            .select(F.concat(F.lit("window_"), F.col("_j").cast("string")).alias("window_id"),
                    (F.col("_j") * F.lit(step)).cast("long").alias("start_idx"),
                    F.least(F.col("_j") * F.lit(step) + F.lit(window_size), F.lit(n))
                    .cast("long").alias("end_idx"),
                    _ts(first[TS_US]).alias("start_time"), _ts(last[TS_US]).alias("end_time"),
                    ((last[TS_US] - first[TS_US]) / F.lit(1e6)).alias("time_span"),
                    F.col("log_count").cast("int").alias("log_count"),
                    ids.alias("template_sequence"),
                    P.ids_to_string(ids).alias("template_sequence_str"),
                    F.size(F.array_distinct(ids)).alias("unique_templates")))


def window_means(windows: DataFrame) -> DataFrame:
    """Average log count and time span (NULL on empty input)."""
    return windows.agg(F.avg("log_count").alias("avg_log_count"),
                       F.avg("time_span").alias("avg_time_span"))


def _order_columns(df: DataFrame) -> DataFrame:
    """PF9: seven priority columns first, the rest after."""
    first = [c for c in PRIORITY_COLUMNS if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def block_logs(ordered: OrderedLogs) -> DataFrame:
    """J5/PF10 for blocks: every block log tagged with its sequence (1:1)."""
    logs = ordered.full.filter(F.col("block_id").isNotNull()).drop(TS_US)
    return _order_columns(logs.withColumn("sequence_id", F.concat(F.lit("block_"), F.col("block_id")))
                          .withColumn("sequence_type", F.lit("block")))


def window_logs(ordered: OrderedLogs, window_size_seconds: int = 60, overlap_seconds: int = 0,
                membership: DataFrame | None = None) -> DataFrame:
    """J5/PF10 for time windows: one row per (log, window) -- overlap duplicates logs."""
    mem = membership if membership is not None else time_window_membership(
        ordered, window_size_seconds, overlap_seconds, rows=ordered.full)
    ids = O.dense_ids(mem.select("_k"), "_k", "_wid")
    return _order_columns(
        mem.join(ids, "_k")
        .withColumn("sequence_id", F.concat(F.lit("time_"), F.col("_wid").cast("string")))
        .withColumn("sequence_type", F.lit("time_window"))
        .drop("_k", "_wid", O.B, O.S, TS_US))


def sequence_logs(ordered: OrderedLogs, window_size_seconds: int = 60,
                  overlap_seconds: int = 0) -> DataFrame:
    """Block logs and time-window logs in one table."""
    return block_logs(ordered).unionByName(
        window_logs(ordered, window_size_seconds, overlap_seconds), allowMissingColumns=True)


def sequence_stats(sequences: DataFrame) -> DataFrame:
    """Sequences and logs per type."""
    return (sequences.groupBy("type")
            .agg(F.count(F.lit(1)).alias("sequences"), F.sum("length").cast("long").alias("logs")))


def example_sequences(sequences: DataFrame, n: int = 5) -> DataFrame:
    """A7 examples: the first ``n`` sequence ids (a top-n report)."""
    return sequences.select("seq_id", "type", "length").orderBy("seq_id").limit(n)


def block_pieces(ordered: OrderedLogs) -> DataFrame:
    """Pieces of block sequences keyed by ``seq_id`` (``block_<id>``)."""
    logs = (ordered.df.filter(F.col("block_id").isNotNull())
            .withColumn("seq_id", F.concat(F.lit("block_"), F.col("block_id"))))
    return sequence_pieces(logs, ["seq_id"])


#: Ids in a row of the stored piece table.
PIECE_IDS = 10_000


def stored_pieces(pieces: DataFrame, seq_cols: list[str], piece_ids: int = PIECE_IDS) -> DataFrame:
    """The data set form of sequences: (seq cols, piece, first_position, ids), ``piece_ids`` ids to a row.

    Piece p holds the positions from p * piece_ids on, whatever slices the sequence was built from, so the
    table is the same for every cluster, and a hot sequence is many rows in many files.  Only (sequence,
    slice, count) goes through the per-sequence window; the ids get their offset back by a join on the slice."""
    w = Window.partitionBy(*seq_cols).orderBy(O.B, O.S).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*seq_cols, O.B, O.S, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_off"))
    placed = (pieces.join(offsets, [*seq_cols, O.B, O.S])
              .select(*seq_cols, "_off", F.posexplode("ids").alias("_i", "_id"))
              .withColumn("_pos", F.col("_off") + F.col("_i")))
    return (placed.groupBy(*seq_cols, F.floor(F.col("_pos") / piece_ids).alias("piece"))
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "_id"))).alias("_x"))
            .select(*seq_cols, "piece", (F.col("piece") * piece_ids).alias("first_position"), F.col("_x._id").alias("ids")))


def block_headers(ordered: OrderedLogs) -> DataFrame:
    """``block_sequences`` without the ids: seq_id, type, id, length, start_time, end_time, time_span."""
    seqs = (ordered.df.filter(F.col("block_id").isNotNull()).groupBy("block_id")
            .agg(F.count(F.lit(1)).alias("length"), F.min(TS_US).alias("_lo"), F.max(TS_US).alias("_hi")))
    return seqs.select(
        F.concat(F.lit("block_"), F.col("block_id")).alias("seq_id"), F.lit("block").alias("type"), F.col("block_id").alias("id"), "length",
        _ts(F.col("_lo")).alias("start_time"), _ts(F.col("_hi")).alias("end_time"), ((F.col("_hi") - F.col("_lo")) / F.lit(1e6)).alias("time_span"))


def whole_sequences(headers: DataFrame, stored: DataFrame, key: str = "seq_id") -> DataFrame:
    """Headers with ``template_sequence``: one row per sequence, on request only, as it is as large as its sequence."""
    ids = stored.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"])).alias("template_sequence"))
    return headers.join(ids, key)


def feature_pieces(stored: DataFrame, key: str = "seq_id") -> DataFrame:
    """Stored pieces as the feature operators take them."""
    return stored.select(key, F.lit(0).alias(O.B), F.col("piece").cast("long").alias(O.S), "ids", F.size("ids").cast("long").alias("n"))


def window_pieces(windows: DataFrame, key: str = "window_id") -> DataFrame:
    """Count windows are bounded, so each window is a single piece."""
    return windows.select(key, F.lit(0).alias(O.B), F.lit(0).cast("long").alias(O.S),
                          F.col("template_sequence").alias("ids"),
                          F.size("template_sequence").alias("n"))
