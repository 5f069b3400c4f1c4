"""Template mining (OD8) as a batch Spark job, without row order and without Python.

The original tool fed every line to an online prefix-tree miner (similarity
0.4, depth 4).  Here:

1. tokens = message split on white space; tokens containing a digit become
   ``<*>`` (built-in ``transform`` + regex);
2. ``groupBy(tokens)`` collapses lines to distinct patterns (map-side combine:
   millions of lines -> few patterns), keeping count and first line;
3. leaf = (token count, first two tokens) -- what a depth-4 tree routes on;
4. a leaf's patterns are clustered around leaders; a pattern may follow a leader if at least
   ``sim_threshold`` of its positions hold the leader's token (``<*>`` doesn't count).  An inverted index
   holds each pattern under its rarest (position, token) entries, so many that two patterns
   as similar as that share one.  A pattern that has the most lines (ties by text) under all its entries
   leads; the others follow the most similar such leader, and those similar to none go into the next round;
5. per (cluster, position, token) the lines are counted; a token that fewer than
   ``sim_threshold`` of the cluster's lines have at its position is a parameter
   and becomes ``<*>``, any other stays;
6. patterns of a cluster with the same resulting text are one template; ``template_id`` = 1 +
   rank of the template's first line; ids are joined back to lines on the pattern.

All decisions come from grouped counts of patterns, so the result depends neither on
arrival order nor on partitioning, and a leaf that holds most lines is spread over
tasks like any aggregate.  Step 4 compares a pattern with one leader per index entry at most, and a round
decides every pattern that no undecided one of more lines is indexed with: kinds that are all unlike take
one round, however many.  By design: one final template text per id, mining on
``message`` by default (``text_col='raw_line'`` mines whole lines as the original did).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.operators import order as O
from logsift.session import staged

WILDCARD = "<*>"


def masked_tokens(text: F.Column) -> F.Column:
    toks = F.split(F.trim(text), r"\s+")
    return F.transform(toks, lambda t: F.when(t.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(t))


def _with_patterns(parsed: DataFrame, text_col: str) -> DataFrame:
    lines = parsed.withColumn("_tok", masked_tokens(F.col(text_col)))
    return lines.withColumn("_pat", F.array_join("_tok", " "))


def _indexed(pats: DataFrame, sim_threshold: float) -> DataFrame:
    """(leaf, pattern, tokens, n, entries): the entries under which a pattern is indexed.

    Of a pattern's fixed (position, token) entries, similarity asks for ``need`` to be shared.  In one order
    by rarity in the leaf, two such patterns share one of their first size - need + 1 entries; what all
    patterns of a leaf share stands last.  A pattern with fewer than ``need`` entries is like no other."""
    need = F.ceil(F.lit(sim_threshold) * F.size("tokens") - F.lit(1e-9)).cast("int")
    placed = pats.select("leaf", "pattern", F.posexplode("tokens").alias("pos", "token")).filter(F.col("token") != WILDCARD)
    often = placed.groupBy("leaf", "pos", "token").agg(F.count(F.lit(1)).alias("c"))
    by_rarity = (placed.join(often, ["leaf", "pos", "token"]).groupBy("pattern")
                 .agg(F.sort_array(F.collect_list(F.struct("c", "pos", "token"))).alias("e")))
    kept = F.size("e") - need + 1
    entries = F.when(kept > 0, F.transform(F.slice("e", 1, F.greatest(kept, F.lit(1))), lambda x: F.struct(x["pos"].alias("pos"), x["token"].alias("token"))))
    return (pats.select("leaf", "pattern", "tokens", "n").join(by_rarity, "pattern", "left")
            .select("leaf", "pattern", "tokens", "n", F.coalesce(entries, F.array().cast("array<struct<pos:int,token:string>>")).alias("entries")))


def _clustered(pats: DataFrame, sim_threshold: float) -> DataFrame:
    """(pattern, cluster): the text of the leader that each pattern follows (its own, if it leads)."""
    left, out = staged(_indexed(pats, sim_threshold), "indexed"), None
    open_ = left.count()
    while True:
        entry = left.select("leaf", "pattern", "n", F.explode("entries").alias("e")).select("leaf", "pattern", "n", "e.pos", "e.token")
        top = entry.groupBy("leaf", "pos", "token").agg(F.min(F.struct((-F.col("n")).alias("n"), "pattern"))["pattern"].alias("top"))
        met = entry.select("leaf", "pattern", "pos", "token").join(top, ["leaf", "pos", "token"]).groupBy("pattern", "top").agg(F.count(F.lit(1)).alias("k"))
        # a pattern leads if it is the top of all its entries, or has none
        beaten = met.filter("pattern <> top").select("pattern").distinct()
        leads = left.join(beaten, "pattern", "left_anti").select(F.col("pattern").alias("top"), F.col("tokens").alias("of"), F.col("n").alias("of_n"))
        same = F.size(F.filter(F.zip_with("tokens", "of", lambda x, y: (x == y) & (x != F.lit(WILDCARD))), lambda z: z))
        near = (met.filter("pattern <> top").join(leads, "top").join(left.select("pattern", "tokens"), "pattern")
                .withColumn("s", same / F.size("tokens")).filter(F.col("s") >= F.lit(sim_threshold))
                .groupBy("pattern").agg(F.min(F.struct(-F.col("s"), -F.col("of_n"), "top"))["top"].alias("cluster")))
        done = staged(near.unionAll(leads.select("top", "top")), "clusters")
        out = done if out is None else out.unionAll(done)
        open_ -= done.count()
        if not open_:
            return out
        left = staged(left.join(done.select("pattern"), "pattern", "left_anti"), "indexed")


def template_table(parsed: DataFrame, text_col: str = "message", sim_threshold: float = 0.4,
                   prefix_tokens: int = 2) -> DataFrame:
    """One row per distinct masked pattern: (pattern, template_id, template_str,
    lines, first_line).  Small (distinct patterns, not lines)."""
    lines = _with_patterns(parsed, text_col)
    pats = (lines.groupBy(F.col("_pat").alias("pattern"))
            .agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n"))
            .withColumn("tokens", F.split("pattern", " ")))
    leaf = F.concat_ws("\u0001", F.size("tokens").cast("string"),
                       F.array_join(F.slice("tokens", 1, prefix_tokens), "\u0001"))
    pats = staged(pats.withColumn("leaf", leaf), "patterns")
    # a leader's text names its cluster; from here on the clusters stand for the leaves
    pats = pats.drop("leaf").join(_clustered(pats, sim_threshold).withColumnRenamed("cluster", "leaf"), "pattern")
    placed = pats.select("pattern", "leaf", "n", F.posexplode("tokens").alias("pos", "token"))
    per_leaf = pats.groupBy("leaf").agg(F.sum("n").alias("leaf_n"))
    counts = (placed.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("m")).join(per_leaf, "leaf")
              .select("leaf", "pos", "token", (F.col("m") >= F.lit(sim_threshold) * F.col("leaf_n")).alias("fixed")))
    kept = F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(WILDCARD))
    # one row per token of a pattern: a pattern is one line's worth of tokens
    texts = (placed.join(counts, ["leaf", "pos", "token"]).groupBy("pattern")
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", kept.alias("t")))), lambda x: x["t"]), " ").alias("template_str")))
    out = pats.select("pattern", "leaf", "n", "first_line").join(texts, "pattern")
    first = out.groupBy("leaf", "template_str").agg(F.min("first_line").alias("cluster_first"))
    ids = O.dense_ids(first, "cluster_first", "_cid")
    return (out.join(first, ["leaf", "template_str"]).join(ids, "cluster_first")
            .select("pattern", (F.col("_cid") + 1).cast("int").alias("template_id"), "template_str",
                    F.col("n").alias("lines"), "first_line"))


def mine_templates(parsed: DataFrame, text_col: str = "message", sim_threshold: float = 0.4,
                   prefix_tokens: int = 2) -> DataFrame:
    """Adds ``template_id`` (int) and ``template_str`` to every parsed line
    (lines join the pattern table; AQE broadcasts it when small and splits a
    hot pattern's partition otherwise)."""
    table = template_table(parsed, text_col, sim_threshold, prefix_tokens)
    mapping = table.select(F.col("pattern").alias("_pat"), "template_id", "template_str")
    return _with_patterns(parsed, text_col).join(mapping, "_pat").drop("_tok", "_pat")


def template_summary(parsed: DataFrame, **options) -> DataFrame:
    """Per template: lines and first line, aggregated from the pattern table."""
    t = template_table(parsed, **options)
    return t.groupBy("template_id", "template_str").agg(F.sum("lines").alias("lines"),
                                                       F.min("first_line").alias("first_line"))


def token_patterns(parsed: DataFrame, text_col: str = "message", prefix_tokens: int = 2) -> DataFrame:
    """OD8 steps 1-3 as a table: pattern, token count, leaf prefix, lines, first line."""
    lines = parsed.withColumn("_tok", masked_tokens(F.col(text_col)))
    return (lines.groupBy(F.array_join("_tok", " ").alias("pattern"))
            .agg(F.first(F.size("_tok")).alias("token_count"),
                 F.first(F.array_join(F.slice("_tok", 1, prefix_tokens), " ")).alias("leaf_prefix"),
                 F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line")))
