"""Near-duplicate documents by a chosen-path set similarity join.

Each document is a set of word shingles, embedded as minwise coordinates: coordinate i is
the least of the set's hashes under the i-th function, so two sets agree on one with
probability equal to their Jaccard similarity.  A tree starts with all sets at its root.  A
node picks one coordinate, and a second with probability ``SECOND``, and sends every member
to the child that its token there names, so similar sets keep meeting while others part.
Nodes of at most ``SMALL`` members compare all their members; the whole is repeated over
``TREES`` independent trees.  A pair at the threshold that reaches small nodes in one step
is missed by all of them with probability (1 - threshold)^TREES, below 1e-9 at 0.8.  With
1 + SECOND children a step, a pair above 1 / (1 + SECOND) keeps meeting at any depth with a
probability that doesn't fall (0.6 a tree at 0.85), so deep nodes are missed once in 1e6.

A large node first links its members to one of them, its pivot (exact check on whole sets).
Then members that links connect by now share a label, their component's; only nodes with
several labels go on, and only pairs with different labels are ever compared, once.  A dense
group of thousands of near copies thus costs a comparison each, while every member that isn't
yet connected keeps being compared.  The second level goes ``STEPS`` steps at once.  What is still in
large nodes with several labels are texts that are alike without being linked, such as many that
share one passage: trees don't part those.  An exact join over these rows ends the search:
rarest-first prefixes with a position filter, under which shared passages pair nobody.  It first
links the rows of each prefix hash to one of them, then joins what that left unconnected.  Both joins
ask the sets' parity bits: the bits in which two sets differ are never more than the hashes in which they
do, so near copies that are just not alike enough pair hardly ever, and no link is lost.

Before whole sets are fetched, the two one-bit sketches of 64 coordinates must differ in few
bits (``max_different``: a pair at the threshold fails once in 1e9), and the parity bits, kept with the coordinates, in no more
than a link allows.  Links are confirmed on whole sets of 64-bit shingle hashes, which only the rows of such pairs need.

Equal sets are first collapsed to the smallest row (128-bit digest), so exact copies cost nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import components, free_name, slices, small, stage, with_row_key

COORDINATES = 64
TREES = 16
SMALL = 32
SECOND = 0.35
LEVELS, STEPS = 2, 4
#: Counters of hashes, which order the prefixes of the last join.
BUCKETS = 1 << 18
#: Hashes that a task counts; it sends a row a bucket that it found, BUCKETS at most.
PER_TASK = 1 << 22


def max_different(num: int, den: int) -> int:
    """Sketch bits in which a pair at the threshold differs at most, but for one chance in 1e9.

    A bit differs with probability (1 - similarity) / 2."""
    from math import comb

    p, tail = (1 - num / den) / 2, 1.0
    for k in range(65):
        tail -= comb(64, k) * p ** k * (1 - p) ** (64 - k)
        if tail < 1e-9:
            return k
    return 64


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and offsets of the coordinates' hash functions."""
    x = shingles.mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return x[:COORDINATES] | np.uint64(1), x[COORDINATES:]


def features(rows: DataFrame, width: int) -> DataFrame:
    """(row, n, digest, sketch, coordinates, bits) of (row, text); coordinates: 64 little-endian 32-bit numbers; bits: ``parity_bits``."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        odd, add = _functions()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = shingles.shingle_sets(batch.column("text").to_pylist(), width)
                n = np.array([len(s) for s in sets], np.int64)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                low = np.zeros((COORDINATES, len(sets)), np.uint32)
                full = np.flatnonzero(n)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for c in range(COORDINATES):
                        low[c, full] = np.minimum.reduceat(((flat * odd[c] + add[c]) >> np.uint64(32)).astype(np.uint32), at)
                token = shingles.mix(low.astype(np.uint64) + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(33))[:, None])
                sketch = ((token & np.uint64(1)) << np.arange(COORDINATES, dtype=np.uint64)[:, None]).sum(0, dtype=np.uint64).view(np.int64)
                sig = np.ascontiguousarray(low.T)
                words = [parity_bits(s) for s in sets]
                bits = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(w) for w in words]).astype(np.int32)), pa.array(np.concatenate(words)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(n), pa.array(digest, pa.binary()), pa.array(sketch),
                     pa.array([s.tobytes() for s in sig], pa.binary()), bits], ["row", "n", "digest", "sketch", "coordinates", "bits"])

    return rows.mapInArrow(run, "row bigint, n bigint, digest binary, sketch bigint, coordinates binary, bits array<bigint>")


def _children(nodes: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member index, child node): a node's one or two coordinates follow from its number alone."""
    h = shingles.mix(nodes)
    first = (h % np.uint64(COORDINATES)).astype(np.int64)
    second = ((h >> np.uint64(8)) % np.uint64(COORDINATES)).astype(np.int64)
    two = ((h >> np.uint64(20)) % np.uint64(1 << 20)).astype(np.float64) / (1 << 20) < SECOND
    two &= second != first
    member = np.concatenate([np.arange(len(nodes)), np.flatnonzero(two)])
    c = np.concatenate([first, second[two]])
    token = low[member, c].astype(np.uint64) + (c.astype(np.uint64) << np.uint64(33))
    return member, shingles.mix(h[member] * np.uint64(0x9E6C63D0876A9A47) + shingles.mix(token))


MEMBERS = "node bigint, row bigint, sketch bigint, n bigint, label bigint"


def roots(reps: DataFrame) -> DataFrame:
    """Level 1 of all trees: (node, row, sketch, n, label); tree t's root picks coordinate t first."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            k = batch.num_rows
            low = np.frombuffer(b"".join(batch.column("coordinates").to_pylist()), "<u4").reshape(k, COORDINATES)
            row, sketch, n = (batch.column(c) for c in ("row", "sketch", "n"))
            for tree in range(TREES):
                c = tree % COORDINATES
                token = low[:, c].astype(np.uint64) + (np.uint64(c) << np.uint64(33))
                node = shingles.mix(shingles.mix(token) + np.uint64((tree + 1) * 0x9E3779B1))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), row, sketch, n, row], ["node", "row", "sketch", "n", "label"])

    return reps.select("row", "sketch", "n", "coordinates").mapInArrow(run, MEMBERS)


def branch(members: DataFrame) -> DataFrame:
    """The next level of (node, row, sketch, n, label, coordinates), ``STEPS`` steps down."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            low = np.frombuffer(b"".join(batch.column("coordinates").to_pylist()), "<u4").reshape(-1, COORDINATES)
            child, member = batch.column("node").to_numpy().view(np.uint64), np.arange(len(low))
            for _ in range(STEPS):
                at, child = _children(child, low[member])
                member = member[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(child.view(np.int64)), *[batch.column(c).take(pa.array(member)) for c in ("row", "sketch", "n", "label")]],
                ["node", "row", "sketch", "n", "label"])

    return members.mapInArrow(run, MEMBERS)


def whole_sets(rows: DataFrame, width: int) -> DataFrame:
    """(row, hashes) of (row, text)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = shingles.shingle_sets(batch.column("text").to_pylist(), width)
                ends = np.cumsum([0] + [len(s) for s in sets])
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["row", "hashes"])

    return rows.mapInArrow(run, "row bigint, hashes array<bigint>")


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``rows`` whose row is in ``ids``.  Where the ids are few enough they are broadcast, and no row is shuffled."""
    return rows.join(small(ids), "row", "left_semi")


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) with den * intersection >= num * union on whole sets, which are intersected in the
    JVM, a pair at a time.  Only sets that are asked for are shuffled, where their ids are few enough to broadcast."""
    def asked(c: str, name: str) -> DataFrame:
        return only(sets, pairs.select(F.col(c).alias("row"))).select(F.col("row").alias(c), F.col("hashes").alias(name))

    both = pairs.join(asked("u", "ha"), "u").join(asked("v", "hb"), "v")
    both = both.withColumn("same", F.size(F.array_intersect("ha", "hb")))
    return both.filter(F.lit(den) * F.col("same") >= F.lit(num) * (F.size("ha") + F.size("hb") - F.col("same"))).select("u", "v")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionAll(x)
    return out


def parity_bits(h: np.ndarray) -> np.ndarray:
    """64-bit words, four to eight bits a hash of a set; a bit tells whether an odd number of hashes fall on it."""
    size = 64 << (max(len(h) - 1, 0) // 16).bit_length()
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_different(a: str, b: str) -> Column:
    """The hashes in which two sets differ at least, by their parity bits; of two lengths, the double one is folded."""
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    fold = lambda x, y: F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q))
    return (F.when(F.size(a) == F.size(b), differ(a, b)).when(F.size(a) == 2 * F.size(b), differ(fold(a, b), b))
            .when(F.size(b) == 2 * F.size(a), differ(a, fold(b, a))).otherwise(0))


def may_link(num: int, den: int) -> Column:
    """Whether (n, bits) and (n2, bits2) differ in few enough hashes for a link, as far as their parity bits tell."""
    return F.lit(num + den) * least_different("bits", "bits2") <= F.lit(den - num) * (F.col("n") + F.col("n2"))


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many hashes of all sets fall into each of ``BUCKETS`` buckets.

    A hash that many sets share has a row in each task that counts it, so each task counts ``PER_TASK`` hashes, however
    many files hold the sets: the rows are at most a sixteenth of the hashes and BUCKETS more."""
    hashes = sets.agg(F.sum(F.size("hashes").cast("long")).alias("n")).first()["n"] or 0

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flat = batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount((flat % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "c"])

    part = sets.select("hashes").coalesce(-(-hashes // PER_TASK) or 1).mapInArrow(count, "bucket bigint, c bigint")
    got = part.groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    often = np.zeros(BUCKETS, np.int64)
    often[got.column("bucket").to_numpy()] = got.column("c").to_numpy()
    return often


def prefixes(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(row, sketch, n, prefix, pos, token, bits): the first hashes of the sets of (row, sketch), complete for the threshold.

    ``sets``: (row, hashes) of these rows.  A set's hashes go in the order of how many of all hashes fall into their bucket, of
    ``BUCKETS``, rare ones first; a hash that has a bucket for itself pairs nobody.  Two sets at the threshold t share one of
    their first n - ceil(t n) + 1 in any common order.  What many texts share stands late in this one."""
    held = sets.sparkSession.sparkContext.broadcast(bucket_counts(sets))

    def head(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, out = [], {"prefix": [], "pos": [], "bits": []}
            for s in batch.column("hashes"):
                h = s.values.to_numpy(zero_copy_only=False).view(np.uint64)
                c = held.value[(h % np.uint64(BUCKETS)).astype(np.int64)]
                first = np.lexsort((h, c))[:len(h) + num * len(h) // -den + 1]
                shared = np.flatnonzero(c[first] > 1)
                n.append(len(h))
                for name, v in (("prefix", h[first[shared]].view(np.int64)), ("pos", shared), ("bits", parity_bits(h))):
                    out[name].append(v)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in v]).astype(np.int32)),
                                              pa.array(np.concatenate([*v, np.zeros(0, np.int64)]))) for v in out.values()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), *lists], ["row", "n", *out])

    heads = sets.mapInArrow(head, "row bigint, n bigint, prefix array<bigint>, pos array<bigint>, bits array<bigint>")
    return (heads.join(members, "row").select("row", "sketch", "n", "prefix", "bits", F.explode(F.arrays_zip("pos", F.col("prefix").alias("token"))).alias("e"))
            .select("row", "sketch", "n", "prefix", F.col("e.pos").alias("pos"), F.col("e.token").alias("token"), "bits"))


def prefix_pairs(pre: DataFrame, other: DataFrame, num: int, den: int, near: int, once: bool = False) -> DataFrame:
    """Pairs (u, v) of rows with different labels that share a prefix hash at places that leave room for the
    overlap that is needed, at the first hash that they share, and whose parity bits don't differ in too many
    hashes for it.  Both tables: (row, sketch, n, prefix, pos, token, bits, label)."""
    other = other.select("token", *[F.col(c).alias(c + "2") for c in ("row", "n", "prefix", "pos", "sketch", "bits", "label")])
    need = F.lit(num) * (F.col("n") + F.col("n2"))  # of (num + den) times the overlap
    room = F.lit(num + den) * F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return (pre.join(other, "token")
            .filter((F.col("row") < F.col("row2") if once else F.col("row") != F.col("row2")) & (F.col("label") != F.col("label2")) & (room >= need)
                    & (F.lit(den) * F.least("n", "n2") >= F.lit(num) * F.greatest("n", "n2")) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch2"))) <= near)
                    & may_link(num, den)
                    & (F.element_at(F.array_intersect("prefix", "prefix2"), 1) == F.col("token")))
            .select(F.least("row", "row2").alias("u"), F.greatest("row", "row2").alias("v")))


def connected(reps: DataFrame, bits: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, root) of the representatives (row, n, sketch, coordinates) that have a link; bits: their (row, n, bits)."""
    near = max_different(num, den)
    # sizes alone rule out most pairs, sketches most of the rest
    close = lambda s1, s2, n1, n2: ((F.lit(den) * F.least(n1, n2) >= F.lit(num) * F.greatest(n1, n2))
                                    & (F.bit_count(F.col(s1).bitwiseXOR(F.col(s2))) <= near))
    level, root, compared = roots(reps), None, []
    for depth in range(1, LEVELS + 1):
        order = F.xxhash64("row", F.lit(depth))  # nodes that share members tend to share their pivot
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min(order).alias("first"),
                                          *([] if depth == 1 else [F.min("label").alias("lo"), F.max("label").alias("hi")]))
        # at first every member has its own label
        sizes = sizes.filter("members > 1" if depth == 1 else "lo <> hi").select("node", "members", "first")
        level = stage(level.join(sizes, "node"), f"paths{depth}")
        large, few = level.filter(F.col("members") > SMALL), level.filter(F.col("members") <= SMALL)
        pivots = large.filter(order == F.col("first")).select("node", F.col("row").alias("p_row"), F.col("sketch").alias("p_sketch"), F.col("n").alias("p_n"), F.col("label").alias("p_label"))
        large = large.join(small(pivots), "node")
        a = few.select("node", "row", "sketch", "n", "label")
        b = few.select("node", F.col("row").alias("r2"), F.col("sketch").alias("s2"), F.col("n").alias("n2"), F.col("label").alias("l2"))
        pairs = a.join(b, "node").filter((F.col("row") < F.col("r2")) & (F.col("label") != F.col("l2")) & close("sketch", "s2", "n", "n2")).select(F.col("row").alias("u"), F.col("r2").alias("v"))
        stars = large.filter((F.col("label") != F.col("p_label")) & close("sketch", "p_sketch", "n", "p_n")).select(
            F.least("row", "p_row").alias("u"), F.greatest("row", "p_row").alias("v"))
        pairs = new_pairs(pairs.unionAll(stars).distinct(), compared, lambda new: alike(new, bits, num, den))
        # whole sets only of rows in pairs
        sets = stage(whole_sets(only(texts, pairs.select(F.explode(F.array("u", "v")).alias("row"))), width), "sets")
        root = widened(root, stage(confirm(pairs, sets, num, den), "links"))
        large = open_members(large, root)
        if depth < LEVELS:
            level = branch(large.join(reps.select("row", "coordinates"), "row").select("node", "row", "sketch", "n", "label", "coordinates"))
    # nodes that are still large: an exact join over their members
    rest = stage(large.select("row", "sketch", "label").distinct(), "rest")
    if rest.limit(1).count():
        sets = stage(whole_sets(only(texts, rest.select("row")), width), "sets")
        pre = stage(prefixes(rest.select("row", "sketch"), sets, num, den), "prefixes")
        # first each hash links its rows to one of them, then what isn't connected yet meets in full
        told = labelled(pre, root)
        heads = told.groupBy("token").agg(F.min_by(F.struct("row", "n", "prefix", "pos", "sketch", "bits", "label"), F.xxhash64("token", "row")).alias("h")).select("token", "h.*")
        root = widened(root, stage(confirm(new_pairs(prefix_pairs(told, heads, num, den, near).distinct(), compared), sets, num, den), "links"))
        told = labelled(pre, root)
        root = widened(root, stage(confirm(new_pairs(prefix_pairs(told, told, num, den, near, once=True).distinct(), compared), sets, num, den), "links"))
    return root


def alike(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) that their parity bits leave: few but the links, and all of these."""
    other = bits.select(F.col("row").alias("v"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    return pairs.join(bits.withColumnRenamed("row", "u"), "u").join(other, "v").filter(may_link(num, den)).select("u", "v")


def new_pairs(pairs: DataFrame, compared: list[DataFrame], alike: Callable[[DataFrame], DataFrame] = lambda new: new) -> DataFrame:
    """Those of the distinct pairs that no earlier step compared and that ``alike`` leaves, written and noted as compared."""
    if compared:
        pairs = pairs.join(union_all(compared), ["u", "v"], "left_anti")
    compared.append(stage(alike(pairs), "pairs"))
    return compared[-1]


def widened(root: DataFrame | None, found: DataFrame) -> DataFrame:
    """The components (node, root) joined further by the links ``found``.

    Links join earlier components, so only these components' smallest rows go on, not all that they hold."""
    if root is None:
        return components(found)
    if not found.limit(1).count():
        return root
    held = small(root)
    for c in ("u", "v"):
        found = found.join(held.select(F.col("node").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    joined = components(stage(found, "links"))
    later = root.join(small(joined.select(F.col("node").alias("root"), F.col("root").alias("to"))), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stage(later.unionAll(joined.join(held, "node", "left_anti")), "components")


def labelled(rows: DataFrame, root: DataFrame) -> DataFrame:
    """``rows`` with the component that the links found so far give each row as its label."""
    root = small(root).withColumnRenamed("node", "row")
    return rows.drop("label").join(root, "row", "left").withColumn("label", F.coalesce("root", "row")).drop("root")


def open_members(large: DataFrame, root: DataFrame) -> DataFrame:
    """(node, row, sketch, n, label) of the nodes whose members links don't all connect by now."""
    large = labelled(large.select("node", "row", "sketch", "n"), root)
    several = large.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("node")
    return large.join(several, "node", "left_semi")


def classes(docs: DataFrame, width: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: row, doc_id, n_shingles, root (row), component_id, kept.

    Links documents whose sets of ``width``-word shingles have Jaccard similarity num / den
    or more; a component is all that links reach.  Needs columns doc_id and text; others are
    ignored.  Null text is empty; a document without words has an empty set and is linked with
    nothing.  A null doc_id sorts last; of rows that repeat a doc_id one is kept (``row`` tells
    them apart, see ``with_row_key``).  An empty table gives an empty result."""
    rows = with_row_key(docs.select("doc_id", "text"), "row")
    texts = rows.select("row", "text")
    feats = stage(features(texts, width), "shingle-features")
    full = feats.filter("n > 0")
    equal = full.groupBy("digest").agg(F.min("row").alias("rep"))
    same = stage(full.select("row", "digest").join(equal, "digest").select("row", "rep"), "equal-sets")
    reps = stage(feats.join(same.filter("row = rep").select("row"), "row", "left_semi").select("row", "n", "sketch", "coordinates"), "representatives")
    root = connected(reps, feats.select("row", "n", "bits"), texts, width, num, den).withColumnRenamed("node", "rep")
    placed = same.join(root, "rep", "left").select("row", F.coalesce("root", "rep").alias("root"))
    out = feats.select("row", F.col("n").alias("n_shingles")).join(placed, "row", "left").withColumn("root", F.coalesce("root", "row"))
    # the smallest row has the smallest doc_id, which is the row itself where doc_ids are unique
    ids = rows.select("row", "doc_id")
    out = out.join(ids, "row").join(ids.select(F.col("row").alias("root"), F.col("doc_id").alias("component_id")), "root")
    return out.select("row", "doc_id", "n_shingles", "root", "component_id", (F.col("row") == F.col("root")).alias("kept"))


def drop_near(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (all its columns) with one document of each component, the smallest doc_id."""
    row = free_name(docs, "lt_row")
    keyed = with_row_key(docs, row)
    gone = classes(keyed.select(F.col(row).alias("doc_id"), "text"), width, num, den).filter("not kept").select(F.col("doc_id").alias(row))
    return keyed.join(gone, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
