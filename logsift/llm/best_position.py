"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

Documents are cut into shards.  Per shard a term's list holds its documents by falling impact.  A search
reads its terms' lists from the top, side by side; every document met is looked up in all lists by
direct access, which gives its score and its position in each of them.  A list's best position is the
end of the run of positions, from the top, that have been seen by either kind of access.  No document
unseen in all lists can score more than the impacts at the best positions sum to, a bound at least as tight
as that of the last read positions; the search stops when it is strictly below the k-th score, so that
equal scores still come to the order by doc_id.

The first pass counts the query terms of every whole text and writes them (and the document's length) as a
table; document frequencies and lengths are grouped aggregates over it.  The second pass makes the shards
of that table's partitions and searches them.  What a task knows is one bounded block of queries and their
terms, not the corpus; more queries take more rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stage

#: All but ASCII letters and digits separates, as far as it is ASCII: fixed by the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters of the queries that one round takes, documents of a shard, positions of a list read at first.
ROUND_CHARS, SHARD_ROWS, FIRST_READ = 4 << 20, 16384, 32


def _table() -> bytes:
    """For ``bytes.translate``: A-Z in lower case, other ASCII but a-z and 0-9 as a space, the rest as it is."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes, table: bytes = _table()) -> list[bytes]:
    return text.translate(table).split(b" ")


def impact(tf: np.ndarray, m: np.ndarray, weight) -> np.ndarray:
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Shard:
    """Impact lists of some documents: per term its documents, impacts and positions."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, ids: np.ndarray):
        """Parallel arrays of postings (any order); ``ids`` the doc_id of each document."""
        order = np.lexsort((docs, terms))
        terms, self.docs, self.impacts, self.ids = terms[order], docs[order], impacts[order], ids
        self.terms, starts = np.unique(terms, return_index=True)
        self.ends = np.append(starts, len(terms))
        # positions by falling impact inside each list
        falling = np.lexsort((self.docs, -self.impacts, terms))
        self.falling = falling
        self.position = np.empty(len(terms), np.int64)
        self.position[falling] = np.arange(len(terms))
        self.at = {int(t): i for i, t in enumerate(self.terms)}

    def search(self, query: dict[int, int], k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The heap (scores, ids) with this shard's documents, and how many documents were looked up.

        ``query``: term -> number of times asked."""
        lists = [(self.at[t], n) for t, n in query.items() if t in self.at]
        if not lists:
            return scores, ids, 0
        spans = [(self.ends[i], self.ends[i + 1], n) for i, n in lists]
        seen = [np.zeros(e - s, bool) for s, e, _ in spans]
        known, read, step = np.zeros(len(self.ids), bool), 0, FIRST_READ
        looked = 0
        while True:
            fresh = [self.docs[self.falling[s + read:min(s + read + step, e)]] for s, e, _ in spans]
            fresh = np.unique(np.concatenate(fresh))
            fresh = fresh[~known[fresh]]
            known[fresh] = True
            read, step = read + step, step * 2
            total = np.zeros(len(fresh), np.int64)
            bound, last = 0, True
            for (s, e, n), marks in zip(spans, seen):
                where = s + np.searchsorted(self.docs[s:e], fresh)  # direct access
                hit = np.flatnonzero(where < e)
                hit = hit[self.docs[where[hit]] == fresh[hit]]
                total[hit] += n * self.impacts[where[hit]]
                marks[self.position[where[hit]] - s] = True
                run = len(marks) if marks.all() else int(np.argmin(marks))
                if run < len(marks):  # the top was read, so the run has one position at least
                    last = False
                    bound += n * int(self.impacts[self.falling[s + run - 1]])
            looked += len(fresh)
            scores, ids = _heap(np.concatenate([scores, total]), np.concatenate([ids, self.ids[fresh]]), k)
            if last or len(scores) == k and bound < scores[-1]:
                return scores, ids, looked


def _heap(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    good = np.flatnonzero(scores > 0)
    if len(good) > 4 * k:
        part = scores[good]
        good = good[part >= np.partition(part, len(part) - k)[len(part) - k]]
    good = good[np.lexsort((ids[good], -scores[good]))[:k]]
    return scores[good], ids[good]


def _count(words):
    """Batches of (doc_id, text) -> doc_id, n terms, and the query terms among them with their counts."""
    def run(batches):
        from collections import Counter

        held = words.value
        for batch in batches:
            for part in slices(batch, "text"):
                n, terms, counts, sizes = [], [], [], [0]
                for text in part["text"]:
                    c = Counter(terms_of(text.as_buffer().to_pybytes())) if text.is_valid else {}
                    c.pop(b"", None)
                    n.append(sum(c.values()))
                    for w in c.keys() & held.keys():
                        terms.append(held[w])
                        counts.append(c[w])
                    sizes.append(len(terms))
                at = pa.array(sizes, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return run


def _searched(known, k: int, rows: int):
    """Batches of counted documents -> the best documents of each query in this partition."""
    def run(batches):
        places, queries, weights, total, length = known.value
        heaps = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)

        def take(held):
            t = pa.Table.from_batches(held)
            n = t["n"].to_numpy()
            m = 25 + 75 * n * total // max(length, 1)
            terms, counts = t["terms"].combine_chunks(), t["counts"].combine_chunks()
            sizes = np.diff(terms.offsets.to_numpy())
            docs = np.repeat(np.arange(len(n)), sizes)
            term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy()
            shard = Shard(term, docs, impact(tf, m[docs], weights[term]), t["doc_id"].to_numpy())
            for q, query in enumerate(queries):
                heaps[q] = shard.search(query, k, *heaps[q])[:2]

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                held.append(batch.slice(at, rows))
                size += held[-1].num_rows
                if size >= rows:
                    take(held)
                    held, size = [], 0
        if size:
            take(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(places, [len(s) for s, _ in heaps])), pa.array(np.concatenate([s for s, _ in heaps])),
             pa.array(np.concatenate([i for _, i in heaps]))], ["place", "score", "doc_id"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 10, round_chars: int = ROUND_CHARS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents of a score above 0, rank from 1.

    ``docs``: doc_id, text.  ``items``: item_id, text.  Terms are maximal runs of ASCII letters and digits and all
    non-ASCII characters, only A-Z lower-cased; a term asked twice counts twice.  Null and empty texts have
    none: such a document is found by nobody and not counted, such an item finds nothing.  A document
    with a null doc_id counts in the statistics but can't be named, so it isn't returned.  Rows that repeat a
    doc_id or item_id are documents or items of their own.  Equal scores go by ascending doc_id.  Other columns are
    ignored; an empty table gives no rows.  Whole texts are read, of every document.

    Items go in rounds of about ``round_chars`` characters (an item longer than that has one of its own), each a pass over the documents."""
    spark = docs.sparkSession
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = stage(asked.select("item_id", "text", F.length("text").cast("long").alias("size"), F.spark_partition_id().alias("file"),
                                F.monotonically_increasing_id().alias("place")), "search-items")
    files = placed.groupBy("file").agg(F.sum("size").alias("size"))  # a row per partition of the items
    before = F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("size").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    placed = stage(placed.join(files.select("file", before.alias("before")), "file").withColumn(
        "round", F.floor((F.col("before") + upto) / round_chars)), "search-items")
    kind = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("rank", T.IntegerType()),
                         T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], kind)
    for r in placed.select("round").distinct().orderBy("round").collect():  # a number for each round's worth of text
        out = out.unionAll(_round(spark, docs, placed.filter(F.col("round") == r["round"]), k, shard_rows))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in kind])


def _round(spark, docs: DataFrame, items: DataFrame, k: int, shard_rows: int) -> DataFrame:
    """One round: ``items`` hold a bounded number of characters, so their terms fit every task."""
    from collections import Counter

    texts = items.orderBy("place").select("place", "text").collect()
    queries = [Counter(t for t in terms_of(r["text"].encode()) if t) for r in texts]
    number = {w: i for i, w in enumerate(sorted(set().union(*queries)))}
    words = spark.sparkContext.broadcast(number)
    counted = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _count(words), "doc_id long, n long, terms array<int>, counts array<long>"), "search-counts")
    whole = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = whole["docs"]
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weights = np.zeros(max(len(number), 1), np.int64)
    for r in df.select("term", weight.alias("w")).collect():  # one row per term of this round's queries
        weights[r["term"]] = r["w"]
    places = np.array([r["place"] for r in texts], np.int64)
    known = spark.sparkContext.broadcast((places, [{number[w]: c for w, c in q.items()} for q in queries], weights, n, whole["words"]))
    found = counted.filter("doc_id is not null and size(terms) > 0").mapInArrow(_searched(known, k, shard_rows), "place long, score long, doc_id long")
    order = [F.col("score").desc(), F.col("doc_id")]
    # lists of partitions meet a few hundred at a time
    near = Window.partitionBy("place", "part").orderBy(*order)
    found = found.withColumn("part", F.floor(F.spark_partition_id() / 256)).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).filter(F.col("rank") <= k)
    return found.join(items.select("place", "item_id"), "place").select("item_id", "rank", "doc_id", "score")
