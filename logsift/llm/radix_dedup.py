"""Exact dedup by distributed MSD radix partitioning.

Texts are byte strings (white-space runs as one space, UTF-8).  Each round splits every
open group by its members' next bytes, a chunk at a time: one grouped count per
(group, chunk) gives the new groups.  A group leaves as soon as it has one member, or
when its text has ended, which a chunk shorter than the round's width shows.  Equality is
decided by the bytes alone; Spark's hash only routes them.

Chunk widths grow eightfold, so a text of b bytes takes about log8(b / 256) rounds, and
each round reads only the rows that still share all bytes so far with another row.

All joins are sort-merge joins, however small a side: an input of any size moves the same share of its bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, normalised, stage, with_row_key

FIRST_WIDTH, GROWTH, MAX_WIDTH = 256, 8, 1 << 24


def radix_groups(texts: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Groups of equal byte strings with two members or more: (row, keep_row, n).

    ``texts``: (row long unique, bytes binary).  ``first``: the same rows as
    (row, head = their first ``FIRST_WIDTH`` bytes), if a narrower table holds them.  The count and the
    smallest row of a (group, chunk) combine map-side; a chunk that a third of all rows
    share is then one row, and joins back through a join that AQE splits."""
    if first is None:
        first = texts.select("row", F.substring("bytes", 1, FIRST_WIDTH).alias("head"))
    width, depth, found, active = FIRST_WIDTH, FIRST_WIDTH, [], None
    groups = first.groupBy("head").agg(F.min("row").alias("gid"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    level = stage(first.join(groups.hint("merge"), "head").select(
        "row", "gid", "n", (F.length("head") < FIRST_WIDTH).alias("ended")), "radix")
    while True:
        found.append(level.filter("ended").select("row", F.col("gid").alias("keep_row"), "n"))
        open_rows = level.filter("not ended")
        if not open_rows.limit(1).count():
            break
        if active is None:  # only rows that share their head carry text from here on
            left = texts.join(open_rows.select("row", "gid").hint("merge"), "row").select(
                "row", "gid", F.expr(f"substring(bytes, {depth + 1})").alias("tail"))
            left = stage(left, "radix-text")
        else:
            left = open_rows.select("row", "gid", "tail")
        width = min(width * GROWTH, MAX_WIDTH)
        cut = left.withColumn("chunk", F.substring("tail", 1, width))
        groups = cut.groupBy("gid", "chunk").agg(F.min("row").alias("next"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        ended = F.length("chunk") < width
        level = stage(cut.join(groups.hint("merge"), ["gid", "chunk"]).select(
            "row", F.col("next").alias("gid"), "n", ended.alias("ended"),
            F.when(~ended, F.expr(f"substring(tail, {width + 1})")).alias("tail")), "radix")
        if active is None:
            discard(left)
        active = level
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def classify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and ``row``.

    Needs columns doc_id and text; others, whatever their names, are ignored.  Null text is
    empty text, and empty texts are equal.  A null doc_id sorts after all others; of rows
    that repeat a doc_id and text exactly one is kept.  An empty table gives an empty result.
    ``row`` numbers the rows as ``with_row_key`` does (doc_id itself where that is unique)."""
    rows = with_row_key(docs.select("doc_id", "text"), "row")
    # one pass over the texts keeps what every row needs: its digest and its first bytes
    body = rows.select("row", "doc_id", F.encode(normalised("text"), "UTF-8").alias("bytes"))
    slim = stage(body.select("row", "doc_id", F.sha2("bytes", 256).alias("text_sha256"),
                             F.substring("bytes", 1, FIRST_WIDTH).alias("head")), "radix-heads")
    groups = radix_groups(body.select("row", "bytes"), slim.select("row", "head"))
    ids = slim.select(F.col("row").alias("keep_row"), F.col("doc_id").alias("keep_id"))
    kept = groups.select("keep_row").distinct().join(ids.hint("merge"), "keep_row")
    classes = groups.join(kept.hint("merge"), "keep_row").select("row", "keep_row", "keep_id", "n")
    return (slim.drop("head").join(classes.hint("merge"), "row", "left")
            .select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("n").isNull() | (F.col("keep_row") == F.col("row"))).alias("kept"),
                    "text_sha256", "row"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` (all its columns) without the rows that ``classify`` doesn't keep."""
    row = free_name(docs, "lt_row")
    keyed = with_row_key(docs, row)
    lost = radix_groups(keyed.select(F.col(row).alias("row"), F.encode(normalised("text"), "UTF-8").alias("bytes"))
                        ).filter("row <> keep_row").select(F.col("row").alias(row))
    return keyed.join(lost.hint("merge"), row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
