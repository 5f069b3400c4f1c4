"""Raw log sources and the parse operator (SC1-SC3, PF1-PF3, F1-F3)."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions import parse as P

#: Offsets (40 bytes a split) are broadcast up to here: 80 MB, or 256 TB in splits of 128 MB.
MAX_BROADCAST_SPLITS = 2_000_000
PARSED_COLUMNS = ["line_no", "timestamp", "level", "component", "message", "block_id", "raw_line"]


def read_log_text(spark: SparkSession, paths, max_lines: int | None = None) -> DataFrame:
    """Read text logs as DataFrame[line_no, value] with a file-order index.

    Spark splits lines on ``\\n``, ``\\r`` and ``\\r\\n``; bad UTF-8 bytes show up
    as U+FFFD and are removed by the parse step.  ``line_no`` is the 0-based
    position over all files in path order: every file split is read by one
    task, so within a split ``monotonically_increasing_id`` is consecutive and
    the index is ``offset(split) + (id - first id of split)``.  The offsets come
    from one small aggregate (one row per split, broadcast back); no window
    over the whole input and no single-task ordering.

    The numbering holds for the split settings in force now: run or persist the result
    before changing them.  A split that wasn't numbered raises an error.

    ``max_lines`` keeps physical lines ``line_no < max_lines`` (unparsed lines
    count), never ``limit()`` which has no order guarantee.  Files are then counted in path order,
    a growing prefix of them and of the splits of a large one, until the limit is reached: files
    behind it are neither opened nor part of the result's plan (but for those of a group that has half the
    lines per byte of the files before).  Of the file that holds the limit,
    splits behind it aren't counted, but the scan passes over them.
    """
    if isinstance(paths, str):
        paths = [paths]
    if max_lines:
        return _first_lines(spark, paths, int(max_lines))
    raw = _raw_lines(spark, paths)
    splits = [(r["_path"], r["_fp"], r["_fb"], r["_n"], r["_first"]) for r in
              raw.groupBy("_fp", "_fb")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"), F.first("_path").alias("_path"))
              .collect()]  # One row per file split: bounded by input size / split size, small.
    return _number(spark, raw, splits, 0)


def _raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return (spark.read.text(paths)
            .select(F.col("value"), F.col("_metadata.file_path").alias("_path"),
                    F.xxhash64("_metadata.file_path").alias("_fp"),
                    F.col("_metadata.file_block_start").alias("_fb"),
                    F.col("_metadata.file_block_length").alias("_len"),
                    F.monotonically_increasing_id().alias("_mid")))


def _number(spark: SparkSession, raw: DataFrame, splits: list[tuple], base: int) -> DataFrame:
    """Lines with ``line_no`` from ``base`` on; ``splits``: (path, hash of it, start, lines, first id) of each split."""
    if len({r[0] for r in splits}) != len({r[1] for r in splits}):
        raise ValueError("two file paths share a hash; rename one")
    offsets, acc = [], base
    for _, fp, start, n, first in sorted(splits, key=lambda r: (r[0], r[2])):
        offsets.append((fp, start, acc, first))
        acc += n
    if not offsets:
        return spark.createDataFrame([], "line_no bigint, value string")
    off = spark.createDataFrame(offsets, "_fp bigint, _fb bigint, _off bigint, _first bigint")
    # one row per file split grows with the input (~800k rows, 32 MB, at 100 TB):
    # broadcast below a fixed bound (the lines aren't shuffled), otherwise an ordinary join
    off = F.broadcast(off) if len(offsets) <= MAX_BROADCAST_SPLITS else off
    known = F.coalesce(F.col("_off") + F.col("_mid") - F.col("_first"),
                       F.raise_error(F.lit("the input was split differently when it was numbered")).cast("long"))
    return raw.drop("_path", "_len").join(off, ["_fp", "_fb"], "left").select(known.alias("line_no"), "value")


def _first_lines(spark: SparkSession, paths: list[str], max_lines: int) -> DataFrame:
    """SC2.  Takes a group of files at a time, one at least and up to half of what the lines found per byte so far
    leave to read, and numbers each group by itself; the result is their union."""
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("f"), "path", "length")
    files = sorted(tuple(r) for r in listed.collect())  # names and sizes only; no content is read
    out, base, at, seen, step = spark.createDataFrame([], "line_no bigint, value string"), 0, 0, 0, 1
    while at < len(files) and base < max_lines:
        end = at + step
        if base:  # half the bytes that the lines still wanted should take, so that a group hardly passes the limit
            end, room = at + 1, (max_lines - base) * seen / base / 2 - files[at][2]
            while end < len(files) and files[end][2] <= room:
                room -= files[end][2]
                end += 1
        step = 1 if base else 2 * step  # only files without a line so far: look further
        batch = files[at:end]
        raw = _raw_lines(spark, [re.sub(r"([\\\[\]{}*?])", r"\\\1", path) for _, path, _ in batch])
        splits, behind = _count_splits(raw, max_lines - base, len(batch) == 1)
        if behind is not None:
            raw = raw.filter(F.col("_fb") < behind)
        if splits:
            out = out.unionAll(_number(spark, raw, splits, base))
        base += sum(s[3] for s in splits)
        seen += sum(size for *_, size in batch) if behind is None else behind
        at = end
    return out.filter(F.col("line_no") < F.lit(max_lines))


def _count_splits(raw: DataFrame, wanted: int, one_file: bool) -> tuple[list[tuple], int | None]:
    """Splits as ``_number`` takes them, and the byte from which on splits weren't counted (None: all were).

    The partitions of a single file follow its bytes, which is checked; they are counted two, four, eight ...
    at a time until ``wanted`` lines are found."""
    def count(batches):
        import pyarrow as pa

        found: dict = {}
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(["_path", "_fp", "_fb", "_len"]).aggregate([("_mid", "count"), ("_mid", "min")])
            for r in t.to_pylist():
                key = (r["_path"], r["_fp"], r["_fb"], r["_len"])
                n, first = found.get(key, (0, r["_mid_min"]))
                found[key] = (n + r["_mid_count"], min(first, r["_mid_min"]))
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema(list(zip(names, kinds(pa)))))

    names = ["path", "fp", "fb", "len", "n", "first"]
    kinds = lambda pa: [pa.string(), *[pa.int64()] * 5]
    counted = raw.drop("value").mapInArrow(count, "path string, fp long, fb long, len long, n long, first long").rdd
    sc, parts = raw.sparkSession.sparkContext, counted.getNumPartitions()
    rows, at, step = [], 0, 1
    while at < parts and not (one_file and sum(r["n"] for r in rows) >= wanted):
        step = 2 * step if one_file else parts
        rows += sc.runJob(counted, list, range(at, min(at + step, parts)))
        at += step
    splits = [(r["path"], r["fp"], r["fb"], r["n"], r["first"]) for r in rows]
    if at >= parts:
        return splits, None
    rows.sort(key=lambda r: r["fb"])
    ends = [0] + [r["fb"] + r["len"] for r in rows]
    if [r["fb"] for r in rows] != ends[:-1]:  # a split without a line start, or another order: count the rest as well
        rows += sc.runJob(counted, list, range(at, parts))
        return [(r["path"], r["fp"], r["fb"], r["n"], r["first"]) for r in rows], None
    return splits, ends[-1]


def _fields(lines: DataFrame, line_col: str, date_layout: str) -> DataFrame:
    """All lines with parsed fields; ``_ok`` tells whether the line parsed."""
    clean = lines.select("line_no", P.clean_line(F.col(line_col)).alias("raw_line"))
    line = F.col("raw_line")
    h = P.header_fields(line)
    ok = (F.length(line) > 0) & P.line_matches(line)
    return (clean
            .select("line_no", "raw_line", ok.alias("_ok"),
                    h["date"].alias("_d"), h["time"].alias("_t"), h["third"].alias("_f3"),
                    h["level"].alias("level"), h["component"].alias("component"),
                    h["message"].alias("message"))
            .withColumn("timestamp", P.timestamp_from_fields(F.col("_d"), F.col("_t"),
                                                             F.col("_f3"), date_layout)))


def parse_lines(lines: DataFrame, date_layout: str = "reference", all_blocks: bool = False,
                line_col: str = "value") -> DataFrame:
    """Parse DataFrame[line_no, value] into the typed log table.

    Blank and non-matching lines are dropped; ``timestamp`` is NULL when the
    date/time digits are invalid; ``block_id`` is the first ``blk_`` id of the
    message (all ids, one row each, with ``all_blocks``).  In ``yymmdd`` layout
    the third header field is kept as ``field3``.

    ``all_blocks`` (D13) is meant for block sequences: a line naming two
    blocks becomes two rows, so parse windows from the default form, where
    every line is one row.
    """
    out = _fields(lines, line_col, date_layout).filter(F.col("_ok"))
    if all_blocks:
        ids = P.block_id(F.col("message"), True)
        out = out.withColumn("block_id", F.explode_outer(F.when(F.size(ids) > 0, ids)))
    else:
        out = out.withColumn("block_id", P.block_id(F.col("message")))
    cols = list(PARSED_COLUMNS)
    if date_layout == "yymmdd":
        out = out.withColumn("field3", F.col("_f3").try_cast("bigint"))
        cols.append("field3")
    return out.select(*cols)


def parse_logs(lines: DataFrame, templates: str | None = "mine", date_layout: str = "reference",
               all_blocks: bool = False, persist: bool = True, **mine_options) -> DataFrame:
    """Lines -> parsed logs with ``template_id`` / ``template_str``.

    ``templates``: ``"mine"`` (template mining job), ``"fixture"`` (fixed rule on
    the message, used by oracle checks) or ``None`` (no template columns).

    The parsed table feeds every later operator, so it is persisted here
    (memory, spilling to disk); this also stops later filters from being
    pushed into -- and duplicating -- the parse expressions.  Call
    ``unpersist()`` on the result when done.
    """
    parsed = parse_lines(lines, date_layout=date_layout, all_blocks=all_blocks)
    if persist:
        parsed = parsed.persist(StorageLevel.MEMORY_AND_DISK)
    if templates is None:
        return parsed
    if templates == "fixture":
        from logsift.sources.fixtures import fixture_template_id
        return (parsed.withColumn("template_id", fixture_template_id())
                .withColumn("template_str", F.lit(None).cast("string")))
    if templates == "mine":
        from logsift.operators.templates import mine_templates
        return mine_templates(parsed, **mine_options)
    raise ValueError(f"unknown templates mode {templates!r}")


def parse_stats(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """A6 (one row): total lines, parsed lines, valid timestamps, lines with a
    block id, distinct template ids.

    ``parsed`` holds one row per parsed line (the default parse; with
    ``all_blocks`` it has one row per block id).  Counts come from the
    persisted parsed table, so lines are not parsed a second time; the two
    one-row partial aggregates merge by a union + max (no join)."""
    a = lines.agg(F.count(F.lit(1)).alias("total_lines"))
    b = parsed.agg(F.count(F.lit(1)).alias("parsed_lines"),
                   F.count("timestamp").alias("valid_timestamps"),
                   F.count("block_id").alias("with_block_id"),
                   F.count_distinct("template_id").alias("unique_templates"))
    u = a.unionByName(b, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in
                   ["total_lines", "parsed_lines", "valid_timestamps", "with_block_id",
                    "unique_templates"]])
