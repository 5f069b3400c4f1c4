"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Every source has a schedule: its weight at points of training time 0..1, linear between
them.  Over a step the source's share of the tokens is its mean weight (the integral) over
all sources' sum; cumulative demand is the running sum of those shares.  A document copy
that starts c tokens into its source's shuffled order is due when demand reaches c: the
inverse of that curve, in closed form.  Documents range-sorted by that position are the
training order.

Where a source's total would pass ``max_repeat`` times its size, it stops there and the excess
goes to the others by weight (water filling).

Without a given schedule the sources take ``SHAPES`` in turn: the first source falls off over the training, the
second peaks half-way, the third grows.  Their means are 1, so targets don't depend on them.

The per-document running sum inside a source is split: documents hash into buckets, bucket
totals give offsets, and only a bucket is ordered in one task.  The number of buckets of a
source follows its row count, so a source with a third of all rows has a third of all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, free_name, stage, with_row_key

ROWS_PER_BUCKET = 4000
#: Weight of a source over training time, points (t, w); sources take them in turn.
SHAPES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))


def word_size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: float | Column, max_repeat: float) -> DataFrame:
    """Add ``target``: ``total`` shared by ``weight``, none above ``max_repeat * source_size``.

    One row per source goes through one window; sources are few next to documents.  In
    ascending order of cap / weight the capped sources are the prefix whose ratio lies at or
    below the level that the rest would get."""
    by = Window.orderBy("ratio", "rank")
    upto, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = sources.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    s = s.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    left = F.greatest(F.lit(total) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)), F.lit(0.0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    s = s.withColumn("level", F.when(weight > 1e-12, left / weight))
    s = s.withColumn("over", F.col("ratio") <= F.col("level"))
    # the level of the first source that is not capped holds for all after it
    level = F.min(F.when(~F.coalesce("over", F.lit(True)), F.struct("ratio", "rank", "level"))).over(whole)["level"]
    s = s.withColumn("fill", level)
    return s.withColumn("target", F.when(F.coalesce("over", F.lit(True)) | F.col("fill").isNull(), F.col("cap"))
                        .otherwise(F.least("cap", F.col("weight") * F.col("fill")))).drop("ratio", "level", "over", "fill", "cap")


def schedule_curve(sources: DataFrame, schedule: DataFrame) -> DataFrame:
    """Cumulative demand per source and step: (source_key, d0, t0, t1, w0, w1, scale), d0 = demand at t0.

    ``schedule``: (source_key, t, w), t from 0 to 1, linear between points; a source without
    rows there has weight 1 throughout.  The integral of a linear piece is its mean height
    times its length.  A source's demand is scaled to end at its target."""
    w = Window.partitionBy("source_key").orderBy("t")
    pieces = (schedule.withColumn("t1", F.lead("t").over(w)).withColumn("w1", F.lead("w").over(w)).filter("t1 is not null and t1 > t")
              .select("source_key", F.col("t").alias("t0"), "t1", F.col("w").alias("w0"), "w1"))
    flat = sources.select("source_key").join(pieces.select("source_key").distinct(), "source_key", "left_anti").select(
        "source_key", F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), F.lit(1.0).alias("w0"), F.lit(1.0).alias("w1"))
    pieces = pieces.unionAll(flat).withColumn("area", (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0")))
    w = Window.partitionBy("source_key")
    done = F.coalesce(F.sum("area").over(w.orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pieces = pieces.withColumn("all", F.sum("area").over(w)).withColumn("before", done)
    scale = F.when(F.col("all") > 0, F.col("target") / F.col("all")).otherwise(F.lit(0.0))
    return (pieces.join(sources.select("source_key", "target"), "source_key").withColumn("scale", scale)
            .select("source_key", (F.col("before") * F.col("scale")).alias("d0"), "t0", "t1", "w0", "w1", "scale"))


def due(at: Column, s: Column) -> Column:
    """Training time at which demand reaches ``at`` within step ``s``: inside a step the weight is
    linear and demand a parabola, w0 x + (w1 - w0) x^2 / 2 length = need, solved for x."""
    length = s["t1"] - s["t0"]
    need = F.when(s["scale"] > 0, (at - s["d0"]) / s["scale"]).otherwise(F.lit(0.0))
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + F.when(length > 0, 2 * need * (s["w1"] - s["w0"]) / length).otherwise(F.lit(0.0)), F.lit(0.0)))
    x = F.when(s["w0"] + root > 0, 2 * need / (s["w0"] + root)).otherwise(F.lit(0.0))
    return s["t0"] + F.least(F.greatest(x, F.lit(0.0)), length)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2,
        schedule: DataFrame | None = None, seed: str = "0", shapes: tuple = SHAPES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, takes, sources) of a mix of ``share`` times all words.

    documents: row, doc_id, source_key, size, source_size, target.  takes: row, copy (from 0),
    words, position (0..1) for each copy that the mix takes.  sources: source_key, rank,
    weight, source_size, target.

    Size is the number of words; null text has none and is never taken.  Sources go by code
    point, null last (as a key: struct of is-null and name), and take ``weights`` in turn; a
    source with a row in ``schedule`` (source, t, w) keeps that curve's shape over training time, one without is
    even; with no schedule at all the sources take ``shapes`` in turn.
    A source's documents are taken in the order of an md5 of seed and row: whole passes first, then
    the documents of one more pass that start before the target.  Equal order
    keys fall back on the row, so reruns agree.  Extra columns are ignored; repeated doc_ids are
    rows of their own; an empty table gives empty results."""
    rows = with_row_key(docs.select("doc_id", "text", "source"), "row")
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    slim = rows.select("row", "doc_id", key.alias("source_key"), word_size().alias("size"),
                       F.md5(F.concat_ws(":", F.lit(seed), F.col("row").cast("string"))).alias("u"))
    slim = stage(slim, "mix-sizes")
    sizes = slim.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy("source_key")) - 1
    cycle = F.lit([float(x) for x in weights])
    sources = sizes.withColumn("rank", rank).withColumn("weight", F.get(cycle, F.col("rank") % len(weights)))
    sources = sources.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
    sources = water_fill(sources, F.col("total"), max_repeat).drop("total")
    sources = stage(sources.withColumn("buckets", F.ceil(F.col("n") / ROWS_PER_BUCKET).cast("long")), "mix-sources")

    # eight hex digits of the order key give a number that ascends with it, so buckets are in key order
    docs_s = slim.join(sources.select("source_key", "source_size", "target", "buckets"), "source_key")
    number = F.conv(F.substring("u", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    docs_s = docs_s.withColumn("bucket", F.floor(number * F.col("buckets")))
    per = docs_s.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("source_key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("u", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (docs_s.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(offsets, ["source_key", "bucket"])
              .withColumn("start", F.col("offset") + F.col("inner")))
    copies = (placed.filter("size > 0")
              .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
              .withColumn("at", F.col("start") + F.col("copy") * F.col("source_size"))
              # a copy counts when the larger part of it lies before the target
              .filter(F.col("at") + F.col("size") / 2.0 <= F.col("target")))
    if schedule is not None:
        curve = schedule.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("source_key"),
                                F.col("t").cast("double").alias("t"), F.col("w").cast("double").alias("w"))
    else:
        points = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in s]) for s in shapes])
        curve = sources.select("source_key", F.explode(F.get(points, F.col("rank") % len(shapes))).alias("x")).select("source_key", "x.t", "x.w")
    steps = schedule_curve(sources, curve)
    line = steps.groupBy("source_key").agg(F.sort_array(F.collect_list(F.struct("d0", "t0", "t1", "w0", "w1", "scale"))).alias("line"))
    hit = F.element_at(F.filter("line", lambda s: s["d0"] <= F.col("at")), -1)
    copies = copies.join(line, "source_key").withColumn("hit", hit)
    pos = due(F.col("at"), F.col("hit"))
    takes = copies.select("row", "copy", F.col("size").alias("words"), F.least(pos, F.lit(1.0)).alias("position"))
    documents = docs_s.select("row", "doc_id", "source_key", "size", "source_size", "target")
    return documents, takes, sources


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in training order: a row for each copy taken, range-sorted by position."""
    row = free_name(docs, "lt_row")
    keyed = with_row_key(docs, row)
    _, takes, _ = mix(keyed.select(F.col(row).alias("doc_id"), "text", "source"), **options)
    pos, copy = free_name(docs, "lt_position"), free_name(docs, "lt_copy")
    takes = takes.select(F.col("row").alias(row), F.col("copy").alias(copy), F.col("position").alias(pos))
    return keyed.join(takes, row).orderBy(pos, row, copy).select(*[f"`{c}`" for c in docs.columns])
