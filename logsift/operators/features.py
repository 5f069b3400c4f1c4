"""Sequence features: n-grams (FE1), term counts (FE2), TF-IDF (FE3),
metadata scaling (FE4), feature table (FE5/FE6) and fitted models (FE7).

Everything is computed in long form -- (sequence, term, value) rows -- with
built-in aggregates:

* n-grams come from the sequence *pieces* (bounded arrays); the last ``n-1`` ids
  of the pieces before a piece are joined back to it, so no operator ever needs a
  whole sequence in one row or task;
* term counts aggregate map-side first; only the top ``max_features`` terms
  (with their document frequency) reach the driver;
* idf is the smoothed form ``ln((1+n)/(1+df)) + 1``; rows are L2-normalised
  over the kept terms (a row with no kept term stays all zero);
* metadata columns are centred and divided by the *population* std (a
  constant column scales to 0).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsift.operators import order as O


# -- n-grams -----------------------------------------------------------------

def ngram_terms(pieces: DataFrame, seq_cols: list[str], ngram_range=(1, 2),
                ids_col: str = "ids") -> DataFrame:
    """(seq cols, term, tf): n-gram counts per sequence, terms joined by a space."""
    lo_n, hi_n = ngram_range
    if lo_n < 1 or hi_n < lo_n:
        raise ValueError(f"bad ngram_range {ngram_range}")
    ids = F.col(ids_col)
    if hi_n > 1:
        keep = hi_n - 1
        tail = F.slice(ids, F.greatest(F.lit(1), F.size(ids) - F.lit(keep) + 1), keep)
        # only the pieces' last ids go through the per-sequence window; the arrays stay where they
        # are and get their context back by (sequence, slice)
        w = Window.partitionBy(*seq_cols).orderBy(O.B, O.S).rowsBetween(-keep, -1)
        tails = (pieces.select(*seq_cols, O.B, O.S, tail.alias("_tail"))
                 .withColumn("_prev", F.flatten(F.collect_list("_tail").over(w)))
                 .filter(F.size("_prev") > 0).drop("_tail"))
        p = (pieces.join(tails, [*seq_cols, O.B, O.S], "left")
             .withColumn("_prev", F.coalesce("_prev", F.array().cast("array<int>"))))
        prev = F.col("_prev")
        ctx = F.slice(prev, F.greatest(F.lit(1), F.size(prev) - F.lit(keep) + 1), keep)
        p = p.withColumn("_ext", F.concat(ctx, ids)).withColumn("_c", F.size(ctx))
    else:
        p = pieces.withColumn("_ext", ids).withColumn("_c", F.lit(0))
    ext, c, L = F.col("_ext"), F.col("_c"), F.size(F.col("_ext"))
    def gram(n):
        # one-argument lambda: transform() would pass (element, index) to two
        return lambda i: F.array_join(F.transform(F.slice(ext, i + 1, n),
                                                  lambda x: x.cast("string")), " ")

    grams = []
    for n in range(lo_n, hi_n + 1):
        start = F.greatest(F.lit(0), c - F.lit(n - 1))
        last = L - F.lit(n)
        g = F.when(last >= start, F.transform(F.sequence(start, last), gram(n)))
        grams.append(F.coalesce(g, F.array().cast("array<string>")))
    terms = p.select(*seq_cols, F.explode(F.concat(*grams)).alias("term"))
    return terms.groupBy(*seq_cols, "term").agg(F.count(F.lit(1)).alias("tf"))


# -- vocabulary / idf ----------------------------------------------------------

@dataclass
class TfidfModel:
    """Fitted vocabulary: alphabetical ``terms``, their document frequency and idf."""
    terms: list[str]
    doc_freq: list[int]
    n_docs: int
    idf: list[float] = field(default_factory=list)

    def __post_init__(self):
        if not self.idf:
            self.idf = [math.log((1 + self.n_docs) / (1 + d)) + 1.0 for d in self.doc_freq]

    @property
    def size(self) -> int:
        return len(self.terms)

    def table(self, spark: SparkSession) -> DataFrame:
        """(term, feature_idx, doc_freq, idf) -- at most max_features rows."""
        rows = [(t, i, d, w) for i, (t, d, w) in enumerate(zip(self.terms, self.doc_freq, self.idf))]
        return spark.createDataFrame(rows, "term string, feature_idx int, doc_freq long, idf double")


def top_terms(terms: DataFrame, max_features: int | None = 1000) -> DataFrame:
    """T4: terms ranked by corpus frequency (ties: term ascending), top K."""
    stats = terms.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("doc_freq"))
    ranked = stats.orderBy(F.desc("cf"), F.asc("term"))
    return ranked.limit(max_features) if max_features else ranked


def fit_tfidf(terms: DataFrame, n_docs: int, max_features: int | None = 1000) -> TfidfModel:
    """Fit the vocabulary (only the top K rows reach the driver)."""
    top = top_terms(terms, max_features).collect()
    kept = sorted((r["term"], r["doc_freq"]) for r in top)
    return TfidfModel([t for t, _ in kept], [d for _, d in kept], n_docs)


def tfidf(terms: DataFrame, model: TfidfModel, seq_cols: list[str]) -> DataFrame:
    """(seq cols, term, feature_idx, tfidf): smoothed tf-idf, L2 row norm.

    The vocabulary table is at most ``max_features`` rows (broadcast)."""
    vocab = F.broadcast(model.table(terms.sparkSession))
    w = terms.join(vocab, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    # rows per sequence <= max_features, so the per-sequence window is bounded
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*seq_cols)))
    return w.select(*seq_cols, "term", "feature_idx", (F.col("_w") / norm).alias("tfidf"))


# -- a vocabulary without a limit: a table, not a list on the driver -----------------------

def dictionary(terms: DataFrame, n_docs: int, parts: int | None = None) -> DataFrame:
    """(term, feature_idx, doc_freq, idf) of every term, indices dense and in term order.

    The terms are range-partitioned and sorted once, in a written table; a term's index is its place in its
    partition behind the partitions before (one count each).  Nothing grows on the driver or in a broadcast."""
    from logsift.session import staged

    stats = terms.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    parts = parts or int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id()
    ranged = staged(stats.repartitionByRange(parts, "term").sortWithinPartitions("term").select(
        "term", "doc_freq", part.alias("_part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("_in")), "dictionary")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    idf = F.log((F.lit(1 + n_docs)) / (1 + F.col("doc_freq"))) + 1
    return ranged.join(offsets, "_part").select("term", (F.col("_off") + F.col("_in")).alias("feature_idx"), "doc_freq", idf.alias("idf"))


def tfidf_by_dictionary(terms: DataFrame, vocabulary: DataFrame, seq_cols: list[str]) -> DataFrame:
    """``tfidf`` with a ``dictionary``: joined on the term, whose hot values AQE splits; the row norm is an
    aggregate joined back, so no window holds a sequence's terms."""
    w = terms.join(vocabulary, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(*seq_cols).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return w.join(norm, seq_cols).select(*seq_cols, "term", "feature_idx", (F.col("_w") / F.col("_norm")).alias("tfidf"))


# -- scaling -------------------------------------------------------------------

@dataclass
class ScalerModel:
    columns: list[str]
    mean: list[float]
    scale: list[float]  # population std, 1.0 where std is 0

    def transform(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        out = df
        for c, m, s in zip(self.columns, self.mean, self.scale):
            out = out.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(m)) / F.lit(s))
        return out


def fit_scaler(df: DataFrame, columns: list[str]) -> ScalerModel:
    """Mean and population std per column (one aggregate row to the driver)."""
    aggs = []
    for c in columns:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    r = df.agg(*aggs).first()
    mean = [float(r[f"m_{c}"] or 0.0) for c in columns]
    scale = [float(r[f"s_{c}"]) if r[f"s_{c}"] else 1.0 for c in columns]
    return ScalerModel(columns, mean, scale)


def scale(df: DataFrame, columns: list[str]) -> DataFrame:
    return fit_scaler(df, columns).transform(df)


# -- feature table ---------------------------------------------------------------

BLOCK_META = ["sequence_length", "time_span"]
WINDOW_META = ["log_count", "time_span", "unique_templates"]


@dataclass
class FeatureModel:
    """Fitted feature transform: vocabulary + scaler (FE7)."""
    tfidf: TfidfModel
    scaler: ScalerModel
    ngram_range: tuple = (1, 2)

    @property
    def names(self) -> list[str]:
        """FE6: ``tfidf_<term>`` then ``<meta>_scaled``."""
        return [f"tfidf_{t}" for t in self.tfidf.terms] + [f"{c}_scaled" for c in self.scaler.columns]

    @property
    def size(self) -> int:
        return self.tfidf.size + len(self.scaler.columns)


def fit_features(seqs: DataFrame, pieces: DataFrame, key: str, meta: list[str],
                 max_features: int | None = 1000, ngram_range=(1, 2),
                 n_docs: int | None = None) -> FeatureModel:
    terms = ngram_terms(pieces, [key], ngram_range)
    n = n_docs if n_docs is not None else seqs.count()
    return FeatureModel(fit_tfidf(terms, n, max_features), fit_scaler(seqs, meta),
                        tuple(ngram_range))


def feature_table(seqs: DataFrame, pieces: DataFrame, key: str, model: FeatureModel) -> DataFrame:
    """FE5: (key, meta..., feat_idx array<int>, feat_val array<double>) -- a sparse row.

    Text features take indices 0..K-1 (alphabetical vocabulary), metadata the
    next ones.  Arrays hold at most ``max_features + len(meta)`` entries."""
    terms = ngram_terms(pieces, [key], model.ngram_range)
    tf = tfidf(terms, model.tfidf, [key])
    sparse = (tf.groupBy(key)
              .agg(F.sort_array(F.collect_list(F.struct("feature_idx", "tfidf"))).alias("_tv")))
    scaled = model.scaler.transform(seqs)
    k = model.tfidf.size
    meta_idx = F.array(*[F.lit(k + i) for i in range(len(model.scaler.columns))])
    meta_val = F.array(*[F.col(c + "_scaled") for c in model.scaler.columns])
    out = scaled.join(sparse, key, "left")
    tv = F.coalesce(F.col("_tv"), F.array().cast("array<struct<feature_idx:int,tfidf:double>>"))
    return (out.withColumn("feat_idx", F.concat(F.transform(tv, lambda s: s["feature_idx"]), meta_idx))
            .withColumn("feat_val", F.concat(F.transform(tv, lambda s: s["tfidf"]), meta_val))
            .drop("_tv"))
