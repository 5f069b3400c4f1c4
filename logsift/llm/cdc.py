"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes: each byte adds its fixed number, older bytes shift
out after 32.  A chunk ends where the hash's top bits are zero.  Normalised chunking asks for
more zero bits before the usual chunk size than after it, which pulls lengths towards it; ``SMALLEST``
and ``LARGEST`` bound them.  Boundaries depend on nearby bytes alone, so an insertion moves
text but only touches the chunks around it.

The fingerprint is the set of chunk digests with their lengths.  Containment of one
fingerprint in another is the share of its distinct chunks' total length that the other has too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, even_keys, range_points, slices, with_row_key

SMALLEST, USUAL, LARGEST = 24, 64, 256
#: Zero bits asked for before and after the usual size (FastCDC's level two).
STRICT_BITS, LOOSE_BITS = 8, 4
WINDOW = 32


def _gear() -> np.ndarray:
    """A fixed 32-bit number per byte value."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest(), "big") for b in range(256)], np.uint32)


def rolling(raw: list[bytes], gear: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(gear hash at every byte, start of each text).  Texts are apart by a window of zeros."""
    pad = bytes(WINDOW)
    starts, at = [], 0
    for r in raw:
        starts.append(at)
        at += len(r) + WINDOW
    h = gear[np.frombuffer(b"".join([x for r in raw for x in (r, pad)]), np.uint8)]
    gaps = np.array([s + len(r) for s, r in zip(starts, raw, strict=True)])[:, None] + np.arange(WINDOW)
    h[gaps.ravel()] = 0
    width = 1
    while width < WINDOW:  # the sum over 2w bytes from two sums over w
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h, starts


def cut(raw: list[bytes], gear: np.ndarray) -> list[list[int]]:
    """Chunk ends of each text; the last is its length (none for an empty text)."""
    h, starts = rolling(raw, gear)
    loose_at = np.flatnonzero((h >> np.uint32(32 - LOOSE_BITS)) == 0)
    strict_at = loose_at[(h[loose_at] >> np.uint32(32 - STRICT_BITS)) == 0].tolist()
    loose_at = loose_at.tolist()
    out = []
    for start, r in zip(starts, raw, strict=True):
        end, at, ends = start + len(r), start, []
        while at < end:
            nxt, k = at + LARGEST, bisect_left(strict_at, at + SMALLEST - 1)
            if k < len(strict_at) and strict_at[k] < at + USUAL - 1:
                nxt = strict_at[k] + 1
            else:
                k = bisect_left(loose_at, at + USUAL - 1)
                if k < len(loose_at) and loose_at[k] < at + LARGEST - 1:
                    nxt = loose_at[k] + 1
            at = min(nxt, end)
            ends.append(at - start)
        out.append(ends)
    return out


def fingerprints(texts: list[str], gear: np.ndarray) -> list[dict[str, int]]:
    """Distinct chunk digests of each text with their length in bytes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    blake = hashlib.blake2b
    out = []
    for r, ends in zip(raw, cut(raw, gear), strict=True):
        out.append({blake(r[a:b], digest_size=8).hexdigest(): b - a for a, b in zip([0, *ends], ends)})
    return out


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """Share of a's length that b holds; empty in empty is 1, empty and non-empty are unlike (0)."""
    if not a or not b:
        return float(a == b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def as_text(f: dict[str, int]) -> str:
    """``digest:length`` in digest order, spaces between."""
    return " ".join(f"{d}:{n}" for d, n in sorted(f.items()))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, n_bytes, chunks (array of end, length, digest in text order).

    Needs columns doc_id and text; others are ignored.  Null text is empty text, which has no
    chunks; repeated rows give repeated results; a null doc_id stays null."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        gear = _gear()
        kind = pa.list_(pa.struct([("end", pa.int64()), ("length", pa.int64()), ("digest", pa.string())]))
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                chunks = [[{"end": b, "length": b - a, "digest": hashlib.blake2b(r[a:b], digest_size=8).hexdigest()}
                           for a, b in zip([0, *ends], ends)] for r, ends in zip(raw, cut(raw, gear), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                                                  pa.array([len(r) for r in raw], pa.int64()), pa.array(chunks, kind)],
                                                 ["doc_id", "n_chars", "n_bytes", "chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_chars bigint, n_bytes bigint, chunks array<struct<end:bigint,length:bigint,digest:string>>")


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text (or all)."""
    k = len(text) // 4
    return text[:len(text) - k] + after[:k]


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, and compare with the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The next document is the one with the next larger doc_id; after the last comes the first.
    Needs columns doc_id and text; others are ignored.  Null text is empty.  Rows that
    repeat a doc_id follow each other in the order of ``with_row_key``; a single document is its own next;
    an empty table gives an empty result.

    Rows are dealt once by doc_id range and read in order, one at a time; the first row of a range is
    also sent to the range before it, so no range waits for another."""
    spark = docs.sparkSession
    rows = with_row_key(docs.select("doc_id", "text"), "row")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = range_points(rows, "row", parts)
    bucket = bucket_of(points)
    firsts = {r["bucket"]: r["row"] for r in rows.select("row", bucket("row").alias("bucket")).groupBy("bucket").agg(F.min("row").alias("row")).collect()}
    order = sorted(firsts)  # at most one number per range
    before = {firsts[b]: order[k - 1] for k, b in enumerate(order)}
    keys = even_keys(spark, len(points) + 1)
    own = F.struct(bucket("row").alias("bucket"), F.lit(0).alias("tail"))
    if before:
        prior = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("row"))
        homes = F.when(F.col("row").isin(list(before)), F.array(own, F.struct(prior.alias("bucket"), F.lit(1).alias("tail")))).otherwise(F.array(own))
    else:
        homes = F.array(own)
    dealt = rows.withColumn("home", F.explode(homes)).select(
        F.get(F.lit(keys), F.col("home.bucket")).alias("route"), F.col("home.bucket").alias("bucket"), F.col("home.tail").alias("tail"), "row", "doc_id", "text")
    dealt = dealt.repartition(len(keys), "route").sortWithinPartitions("bucket", "tail", "row")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        gear = _gear()
        held = None  # (bucket, tail, doc_id, text, fingerprint) of the row before
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                prints = fingerprints(texts, gear)
                rows = list(zip(batch.column("bucket").to_pylist(), batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist(), texts, prints, strict=True))
                pairs = [(a, b) for a, b in zip([held, *rows], rows) if a is not None and a[0] == b[0] and not a[1]]
                held = rows[-1] if rows else held
                changed = [edited(a[3], b[3]) for a, b in pairs]
                marks = fingerprints(changed, gear)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[2] for a, _ in pairs], batch.column("doc_id").type),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], pa.string()),
                    pa.array([as_text(a[4]) for a, _ in pairs], pa.string()), pa.array([as_text(m) for m in marks], pa.string()),
                    pa.array([containment(a[4], m) for (a, _), m in zip(pairs, marks, strict=True)], pa.float64()),
                    pa.array([containment(a[4], b[4]) for a, b in pairs], pa.float64())],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
