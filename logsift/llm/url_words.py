"""URL filter: rules first, then host word segmentation and multinomial naive Bayes.

Names like ``cheappills`` are split by a unigram Viterbi search: the segmentation with the
largest product of word probabilities, counted over the whole text of the pages.  Only substrings of
names that occur as words matter, so the distinct names' substrings join the word counts, and each
name is searched with the few words it can hold; no word list is broadcast.

Bayes scores the host's words and the path's tokens.  Features hash into 2^18 buckets, so
the model has a fixed size whatever the data; its counts cover all urls.  Without labelled urls, the
label of a url is whether its segmented host holds one of ``SEEDS``, and Bayes carries
that over to the words and paths that go along with them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stage

#: Words that mark a host as unwanted when no labelled urls are given.
SEEDS = ("ads", "adserver", "adult", "bet", "bets", "betting", "bonus", "casino", "cheap", "clickbait", "escort", "farm", "gambling", "jackpot", "loan", "lottery",
         "malware", "phishing", "pharmacy", "pills", "poker", "porn", "replica", "scam", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "win", "xxx")
#: (rule, verdict): host and path; the host and its subdomains match if the path starts as the rule's.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MAX_RULES = 1000
FEATURES = 1 << 18
#: DNS labels have at most 63 characters; longer names aren't host names and stay whole.
LONGEST_NAME = 63
SEED_COUNT = 50
#: Weight, in tokens, of the shares over all urls in a label's own.
SMOOTH = 10.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first :// up to / ? # or the end, A-Z lower-cased; path: on to ? # or the end.
    Null, or no ://, gives empty strings."""
    layout, text = r"(?s)^.*?://([^/?#]*)([^?#]*)", F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, layout, 1), UPPER, LOWER), F.regexp_extract(text, layout, 2)


def matched_rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as struct(length, rule, verdict), null if none fits (ties: last by code point)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules go into one expression")
    fits = [F.lit(None).cast("struct<length:int,rule:string,verdict:string>")] * 2
    for rule, verdict in rules:
        rh, slash, rp = rule.partition("/")
        hit = ((host == rh) | host.endswith("." + rh)) & path.startswith(slash + rp)
        fits.append(F.when(hit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.greatest(*fits)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the a-z words of the visible text of all pages; tasks add up before the shuffle."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tags = re.compile(rb"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;")
        words = re.compile(rb"(?<![a-z\x80-\xff])[a-z]+(?![a-z\x80-\xff])")
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                for t in batch.column("text").to_pylist():
                    seen.update(words.findall(tags.sub(b" ", (t or "").encode("utf-8", "replace").lower())))
                if len(seen) > 200_000:
                    yield out()
                    seen.clear()
        yield out()

    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def best_split(name: str, words: dict[str, int], total: int) -> list[str]:
    """Unigram Viterbi: the words whose probabilities have the largest product.

    An unknown run of k letters has probability 10^-k / total, which keeps it in one piece.  Ties
    go to the longer last word."""
    scores, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        best, at = -math.inf, 0
        for start in range(max(0, end - LONGEST_NAME), end):
            part = name[start:end]
            n = words.get(part, 0)
            s = scores[start] + (math.log(n / total) if n else -math.log(total) - len(part) * math.log(10))
            if s > best:
                best, at = s, start
        scores.append(best)
        back.append(at)
    out, end = [], len(name)
    while end:
        out.append(name[back[end]:end])
        end = back[end]
    return out[::-1]


def segment_names(names: DataFrame, lexicon: DataFrame, seeds=SEEDS) -> DataFrame:
    """(name, words array) of distinct a-z names."""
    extra = names.sparkSession.createDataFrame([(w, SEED_COUNT) for w in seeds], "word string, n bigint") if seeds else None
    counts = lexicon if extra is None else lexicon.unionAll(extra).groupBy("word").agg(F.sum("n").alias("n"))
    total = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) + 1
    short = names.filter(F.length("name") <= LONGEST_NAME)
    parts = (short.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("name"))))
             .withColumn("size", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("at") + 1)))
             .select("name", F.col("name").substr(F.col("at"), F.col("size")).alias("word")).distinct())
    # a name has at most 63 * 64 / 2 substrings, so its list of words is short
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            split = []
            for name, known in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist(), strict=True):
                split.append([name] if len(name) > LONGEST_NAME else best_split(name, {k["word"]: k["n"] for k in known or []}, total))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(split, pa.list_(pa.string()))], ["name", "words"])

    return names.join(known, "name", "left").mapInArrow(run, "name string, words array<string>")


def naive_bayes(tokens: DataFrame) -> tuple[np.ndarray, float] | None:
    """(log likelihood ratio of each bucket, log prior ratio), block over allow, from (features array<int>, label
    'block' or 'allow'); None if a label has no rows."""
    sizes = {r["label"]: r["n"] for r in tokens.filter("label in ('allow', 'block')").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    got = (tokens.select((F.col("label") == "block").cast("int").alias("c"), F.explode("features").alias("b"))
           .filter("c is not null").groupBy("c", "b").agg(F.count(F.lit(1)).alias("n")).toArrow())  # 2 x FEATURES rows at most
    counts = np.zeros((2, FEATURES))
    counts[got["c"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
    # each label's shares are smoothed towards all urls', so a rare word alone says little
    seen = counts.sum(0) > 0
    share = SMOOTH * counts.sum(0) / max(1.0, counts.sum())
    ratio = np.zeros(FEATURES)
    p = [np.log((c[seen] + share[seen]) / (c.sum() + SMOOTH)) for c in counts]
    ratio[seen] = p[1] - p[0]
    return ratio, math.log(sizes["block"] / sizes["allow"])


def judge(urls: DataFrame, rules=RULES, seeds=SEEDS, labelled: DataFrame | None = None) -> DataFrame:
    """One row per url: id, host, path, rule, verdict, score, host_words.

    ``urls``: id, url, text (page text or markup that word counts come from; may be null); other columns are
    ignored.  ``labelled`` (url, label 'allow' or 'block') replaces the seed words as labels.  ``score`` is
    the log odds of block.  A rule's verdict wins; else block if the odds exceed 1.  Null urls and urls
    without :// have empty host and path and are judged by the prior alone.  Repeated rows give repeated results; if no
    url carries one of the two labels there is no model, and all without a rule are allowed."""
    spark = urls.sparkSession
    lexicon = stage(word_counts(urls.select(F.coalesce("text", F.lit("")).alias("text"))), "url-words")

    def read(df: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("url"))
        return df.select(*[c for c in df.columns if c != "url"], host.alias("host"), path.alias("path"))

    pages = read(urls.select("id", "url"))
    hosts = pages.select("host")
    if labelled is not None:
        extra = read(labelled.select("url", "label"))
        hosts = hosts.unionAll(extra.select("host"))
    hosts = hosts.distinct()
    in_order = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit("[a-z]+|[0-9]+"), F.lit(0))).alias("at", "name"))
    names = segment_names(in_order.filter(F.col("name") >= "a").select("name").distinct(), lexicon, seeds)
    spans = in_order.join(names, "name", "left").select("host", "at", F.coalesce("words", F.array(F.lit("#"))).alias("words"))
    by_host = spans.groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("host_words"))
    by_host = stage(hosts.join(by_host, "host", "left").withColumn("host_words", F.coalesce("host_words", F.array().cast("array<string>"))), "url-hosts")

    def featured(df: DataFrame) -> DataFrame:
        # digits become one token: page numbers carry no word
        path = F.regexp_replace(F.translate("path", UPPER, LOWER), "[0-9]+", "#")
        words = F.filter(F.split(path, r"[^a-z#\x{80}-\x{10FFFF}]+"), lambda x: x != "")
        tokens = F.concat(F.transform("host_words", lambda x: F.concat(F.lit("h:"), x)), F.transform(words, lambda x: F.concat(F.lit("p:"), x)))
        df = df.join(by_host, "host")
        return df.withColumn("features", F.transform(tokens, lambda x: F.pmod(F.xxhash64(x), F.lit(FEATURES)).cast("int")))

    pages = featured(pages)
    if labelled is not None:
        known = featured(extra)
    else:
        known = pages.withColumn("label", F.when(F.arrays_overlap("host_words", F.lit(list(seeds))), "block").otherwise("allow")) if seeds else None
    model = naive_bayes(known) if known is not None else None
    if model is None:
        scored = pages.withColumn("score", F.lit(None).cast("double"))
    else:
        send, prior = spark.sparkContext.broadcast(model[0]), model[1]  # FEATURES numbers

        @F.pandas_udf("double")
        def odds(features: pd.Series) -> pd.Series:
            sizes = np.array([0 if f is None else len(f) for f in features], np.int64)
            flat = np.concatenate([f for f in features if f is not None and len(f)] or [np.zeros(0, np.int64)]).astype(np.int64)
            ends = np.cumsum(sizes)
            run = np.concatenate([[0.0], np.cumsum(np.rint(send.value[flat] * (1 << 30)).astype(np.int64))])
            return pd.Series((run[ends] - run[ends - sizes]) / (1 << 30) + prior)

        scored = pages.withColumn("score", odds("features"))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.coalesce("score", F.lit(0.0)) > 0, "block").otherwise("allow")
    return scored.withColumn("fit", rule).select(
        "id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "score", "host_words")
