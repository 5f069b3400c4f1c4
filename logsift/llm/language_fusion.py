"""Language identification by Bayesian evidence fusion.

posterior(l) ~ P(text | l) * P(declared | l) * P(suffix | l) * P(l | host)

* text: byte-trigram naive Bayes, trained on a bounded sample of rows with a declared language.
  Trigrams of one text overlap and repeat, so a text counts as at most ``MAX_EVIDENCE`` of them.
* declared markup language and address suffix: how often each goes with each text language,
  counted over all rows by grouped sums of the text posteriors (add-one smoothed).
* host: its rows' text posteriors, smoothed towards its parent domain's, which is smoothed
  towards all rows'.  A row's own share is taken out of its host's and parent's sums.

Scores are whole numbers, summed exactly, so a row's result doesn't depend on its batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stage

BUCKETS = 1 << 16
SCALE = 1000
MAX_EVIDENCE = 100
#: Rows per language that the trigram model is trained on, in expectation.
SAMPLE_PER_LANGUAGE = 400
HOST_WEIGHT = 8.0
MIN_POSTERIOR = 0.5


def _letters() -> bytes:
    """Byte table: ASCII letters lower-cased, bytes of other scripts kept, the rest a space."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, start of each text's trigrams).  A text is lower-cased and stands
    between spaces; trigrams of spaces alone don't count (bucket -1)."""
    table = _letters()
    raw = [b" " + (t or "").lower().encode("utf-8", "replace").translate(table) + b"  " for t in texts]
    starts = np.cumsum([0] + [len(r) for r in raw[:-1]])
    b = np.frombuffer(b"".join(raw) + b"  ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    # a trigram whose middle is a space says nothing about one word
    bucket[(b[1:-1] == 32)] = -1
    return bucket, starts


def train(labelled: DataFrame, languages: list[str]) -> np.ndarray:
    """Whole-number log likelihoods, languages x buckets.  ``labelled``: (text, label)."""
    place = {l: i for i, l in enumerate(languages)}

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[int, int] = {}  # as many as differ in the sample, however many languages there are
        for whole in batches:
            for batch in slices(whole, "text"):
                bucket, starts = trigram_buckets(batch.column("text").to_pylist())
                owner = np.repeat([place[l] for l in batch.column("label").to_pylist()], np.diff([*starts, len(bucket)]))
                keep = bucket >= 0
                cell, n = np.unique(owner[keep].astype(np.int64) * BUCKETS + bucket[keep], return_counts=True)
                for c, x in zip(cell.tolist(), n.tolist()):
                    total[c] = total.get(c, 0) + x
        cells = np.array(list(total), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((cells // BUCKETS).astype(np.int32)), pa.array((cells % BUCKETS).astype(np.int32)),
                                          pa.array(list(total.values()), pa.int64())], ["l", "b", "n"])

    got = (labelled.mapInArrow(count, "l int, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow())
    l, b, n = (got[c].to_numpy() for c in ("l", "b", "n"))
    out = np.empty((len(languages), BUCKETS), np.int32)  # a quarter of a MB per language
    for i in range(len(languages)):
        smooth = np.full(BUCKETS, 0.5)
        smooth[b[l == i]] += n[l == i]
        out[i] = np.rint(np.log(smooth / smooth.sum()) * SCALE)
    return out


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """Add n_grams and loglik (array over languages, tempered) and drop text."""
    send = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))  # buckets x languages
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weights = send.value
        size = weights.shape[1]
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                bucket, starts = trigram_buckets(batch.column("text").to_pylist())
                known = bucket >= 0
                n = np.add.reduceat(known.astype(np.int64), starts)
                bucket[~known] = 0
                sums = np.empty((len(starts), size), np.int64)
                for l in range(size):
                    w = weights[:, l][bucket]
                    w[~known] = 0
                    sums[:, l] = np.add.reduceat(w.astype(np.int64), starts)
                factor = np.minimum(1.0, MAX_EVIDENCE / np.maximum(n, 1)) / SCALE
                flat = (sums * factor[:, None]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(n),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * size), pa.array(flat))],
                    [*keep, "n_grams", "loglik"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{schema}, n_grams bigint, loglik array<double>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, not once for each element that uses it."""
    return F.transform(F.array(value), body)[0]


def _add(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logs: Column) -> Column:
    shifted = lambda l: _let(F.array_max(l), lambda m: F.transform(l, lambda x: F.exp(x - m)))
    return _let(logs, lambda l: _let(shifted(l), lambda e: _let(_add(e), lambda s: F.transform(e, lambda x: x / s))))


def _sum(column: str) -> Column:
    """Sum of arrays, place by place: one aggregate however many languages there are."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(column))))


def _total(df: DataFrame, column: str, size: int) -> np.ndarray:
    r = df.groupBy(F.lit(1)).agg(_sum(column).alias("sums")).first()
    return np.zeros(size) if r is None else np.array(r["sums"])


def _evidence(rows: DataFrame, told: DataFrame, column: str, size: int, out: str) -> DataFrame:
    """``rows`` with log P(value | l) as array ``out``: each value that some told row has is counted, as
    a grouped table that joins back.  Null, or a value no told row has, is no evidence."""
    sums = told.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(_sum("text_posterior").alias("n"))
    sums = stage(sums, "language-values")
    values, nothing = sums.count(), F.lit(np.zeros(size))
    if not values:
        return rows.withColumn(out, nothing)
    total = F.lit(_total(sums, "n", size) + values + 1)
    logs = sums.select("value", F.zip_with("n", total, lambda n, t: F.log((n + 1) / t)).alias(out))
    return rows.join(logs, F.col(column) == F.col("value"), "left").drop("value").withColumn(out, F.coalesce(out, nothing))


def identify(docs: DataFrame, languages: list[str] | None = None, min_posterior: float = MIN_POSTERIOR,
             labelled: DataFrame | None = None) -> DataFrame:
    """Identify each row's language.

    ``docs`` has columns id, text, declared, suffix, host, parent (strings, each may be null or
    missing but id and text); others are ignored.  ``labelled`` (text, label) trains the text
    model; by default a hash sample of the rows with a declared language does, about
    ``SAMPLE_PER_LANGUAGE`` rows a language.  ``languages`` defaults to all that are declared.

    Returns id, language, posterior, text_language, n_grams, accepted, posteriors (by language
    in order), one row per input row, repeated rows included.  A row is accepted if its text has
    letters and its language's posterior reaches ``min_posterior``.  Null or letterless text has
    only its other evidence and isn't accepted.  Ties go to the first language by code point.  An empty
    table, or one without any labelled row, gives language null, posterior 0, accepted false; n_grams
    still tells which texts have letters."""
    have = set(docs.columns)
    base = docs.select("id", "text", *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("declared", "suffix", "host", "parent")])
    if labelled is None:
        counts = base.filter("declared is not null").groupBy("declared").agg(F.count(F.lit(1)).alias("n"))
        if languages is not None:
            counts = counts.filter(F.col("declared").isin(languages))
        counts = stage(counts, "language-counts")
        languages = sorted(r["declared"] for r in counts.select("declared").collect())  # the model has a row for each
        # a row's hash is compared with its language's share: the same on every run
        at = F.pmod(F.xxhash64("id", "declared"), F.lit(1 << 20)) / float(1 << 20)
        picked = base.join(counts, "declared").filter(at < F.lit(float(SAMPLE_PER_LANGUAGE)) / F.col("n"))
        labelled = picked.select(F.coalesce("text", F.lit("")).alias("text"), F.col("declared").alias("label"))
    else:
        labelled = labelled.select(F.coalesce("text", F.lit("")).alias("text"), "label").filter("label is not null")
        languages = sorted(languages or [r["label"] for r in labelled.select("label").distinct().collect()])
        labelled = labelled.filter(F.col("label").isin(languages))
    if not languages:
        plain = score(base, np.zeros((0, BUCKETS), np.int32))
        return plain.select("id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"),
                           F.lit(None).cast("string").alias("text_language"), "n_grams",
                           F.lit(False).alias("accepted"), F.array().cast("array<double>").alias("posteriors"))
    size = len(languages)
    rows = stage(score(base, train(labelled, languages)).withColumn("text_posterior", softmax(F.col("loglik"))), "language-scores")

    told = rows.filter("n_grams > 0")
    total = _total(told, "text_posterior", size) + 1.0
    world = F.lit(total / total.sum())
    hosts = told.groupBy("parent", "host").agg(_sum("text_posterior").alias("host_sums"))
    parents = hosts.groupBy(F.col("parent").alias("pp")).agg(_sum("host_sums").alias("parent_sums"))
    hosts = (hosts.filter("host is not null").select(F.col("parent").alias("hp"), F.col("host").alias("hh"), "host_sums")
             .join(parents, F.col("hp").eqNullSafe(F.col("pp"))))
    hosts = hosts.select("hp", "hh", "host_sums", F.when(F.col("hp").isNotNull(), F.col("parent_sums")).alias("parent_sums"))
    known = _evidence(_evidence(rows, told, "declared", size, "d"), told, "suffix", size, "u")
    keyed = known.join(hosts, F.col("parent").eqNullSafe(F.col("hp")) & (F.col("host") == F.col("hh")), "left")
    nothing = F.lit(np.zeros(size))
    own = F.when(F.col("n_grams") > 0, F.col("text_posterior")).otherwise(nothing)

    def smoothed(sums: Column, prior: Column) -> Column:
        rest = F.zip_with(F.coalesce(sums, own), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return _let(rest, lambda r: _let(_add(r), lambda n: F.zip_with(r, prior, lambda a, p: (a + HOST_WEIGHT * p) / (n + HOST_WEIGHT))))

    prior = F.when(F.col("host_sums").isNull(), world).otherwise(
        smoothed(F.col("host_sums"), F.when(F.col("parent_sums").isNull(), world).otherwise(smoothed(F.col("parent_sums"), world))))
    text = F.when(F.col("n_grams") > 0, F.col("loglik")).otherwise(nothing)
    keyed = keyed.withColumn("prior", prior).withColumn("t", text)
    logs = F.transform(F.arrays_zip("t", "prior", "d", "u"), lambda x: x["t"] + F.log(x["prior"]) + x["d"] + x["u"])
    names = F.from_json(F.lit(json.dumps(languages)), "array<string>")
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    keyed = keyed.withColumn("posteriors", softmax(logs))
    keyed = keyed.withColumn("posterior", F.array_max("posteriors"))
    return keyed.select("id", best(F.col("posteriors")).alias("language"), "posterior",
                        F.when(F.col("n_grams") > 0, best(F.col("text_posterior"))).alias("text_language"), "n_grams",
                        ((F.col("n_grams") > 0) & (F.col("posterior") >= min_posterior)).alias("accepted"), "posteriors")


def documents(docs: DataFrame) -> DataFrame:
    """The ``documents`` table as input: the declared language is ``lang``, the source stands for the host."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))


def web_pages(pages: DataFrame) -> DataFrame:
    """The ``pages`` table as input: <html lang>, last host label and first path part, host and its domain."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    markup = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[#\w]+;", " ")
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/([^/?#]*)", 1)
    return pages.select(F.col("page_id").alias("id"), plain.alias("text"), F.nullif(markup, F.lit("")).alias("declared"),
                        F.nullif(F.concat(F.substring_index(host, ".", -1), F.lit("/"), path), F.lit("/")).alias("suffix"),
                        F.nullif(host, F.lit("")).alias("host"), F.nullif(F.substring_index(host, ".", -2), F.lit("")).alias("parent"))
