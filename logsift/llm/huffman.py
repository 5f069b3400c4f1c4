"""Token ids in a binary format: canonical, length-limited Huffman codes.

Ids are counted over all documents; package-merge gives the optimal code lengths of at most
``limit`` bits; codes follow from the lengths alone (canonical: shorter first, then by id).
A file is a sequence of independent blocks of whole documents.  A block holds the bits of its ids and,
every ``LANE`` ids, a checkpoint: the number of bits since the last one.  A decoder jumps to
any checkpoint, and reads all lanes of many blocks side by side, one table look-up per id: the
next ``limit`` bits index a table of (id, length).

On disk a data set is a folder of two Parquet tables: ``codes`` (id, length; used ids only) and
``blocks``, one file per doc_id range in ascending order:
file, block, first (ids before the block in its file), doc_ids, counts (ids of each document),
lanes (16-bit little-endian bit counts), bits.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsift.session import scratch_path

from .common import bucket_of, discard, even_keys, range_points, slices, stage, with_row_key

LANE = 64
BLOCK_IDS = 1 << 16
LIMIT, MAX_LIMIT = 16, 20


# --- codes -----------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal prefix code lengths of at most ``limit`` bits (package-merge); 0 for unused symbols."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)  # which of the merged items are symbols
        merged = both[by]
        merged = merged[:len(merged) // 2 * 2]
        packages = merged[0::2] + merged[1::2]
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        symbols = int(leaf[:take].sum())
        length[:symbols] += 1
        take = 2 * (take - symbols)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each symbol, in the low bits: by length, then by symbol."""
    codes, used = np.zeros(len(lengths), np.uint32), np.flatnonzero(lengths)
    code = was = 0
    for s in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[s]) - was
        was = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for every value of the next ``limit`` bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    symbol, length = np.zeros(1 << limit, np.int32), np.ones(1 << limit, np.int64)
    total = int(spans.sum())
    symbol[:total], length[:total] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbol, length


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit count of each lane)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    # a code lies in one 32-bit word or in two neighbours; within a word the parts don't overlap
    word, off = starts >> 5, starts & 31
    value = codes[ids].astype(np.uint64) << (64 - off - size).astype(np.uint64)
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros((total >> 5) + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        at = word[first]
        words[at] += np.add.reduceat(value >> np.uint64(32), first)
        words[at + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    lanes = np.add.reduceat(size, np.arange(0, len(ids), LANE)) if len(ids) else np.zeros(0, np.int64)
    return words.astype(">u4").tobytes()[:(total + 7) // 8], lanes


def unpack(bits: list[bytes], lanes: list[np.ndarray], sizes: list[int], table: tuple[np.ndarray, np.ndarray], limit: int) -> np.ndarray:
    """Ids of several blocks, one after the other.  Every lane advances one id per step."""
    symbol, length = table
    n = sum(sizes)
    if not n:
        return np.zeros(0, np.int32)
    raw = np.frombuffer(b"".join(bits) + bytes(8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    base = np.cumsum([0] + [len(b) for b in bits[:-1]]) * 8
    pos = np.concatenate([b + np.cumsum(l) - l for b, l in zip(base, lanes, strict=True)])
    left = np.concatenate([np.minimum(LANE, s - np.arange(0, s, LANE)) for s in sizes])
    out = np.empty((LANE, len(pos)), np.int32)
    mask, top = (1 << limit) - 1, 32 - limit
    for k in range(LANE):  # a lane that has ended reads on inside the padding; its ids are dropped below
        code = (window[np.minimum(pos >> 3, len(window) - 1)] >> (top - (pos & 7))) & mask
        out[k] = symbol[code]
        pos = pos + length[code]
    return out.T[np.arange(LANE) < left[:, None]]


# --- ids of texts ----------------------------------------------------------------------------

#: Fixed value: the word pattern for which words can be encoded one by one.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile(r"[a-zß-öø-ÿ]+")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds(dict):
    """Word -> ids as bytes of ``kind`` numbers, from the tokenizers library.

    Only for a tokenizer that drops white space and never joins across it (``fits``).  The memory of
    words is bounded: when full, what was not used since it last was full is forgotten."""

    REMEMBER = 400_000

    def __init__(self, spec: str, kind: str = "<u4"):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__({"": b""})
        self.kind, self.old, self.code = kind, {}, "H" if kind == "<u2" else "I"  # little-endian machines
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [*range(97, 123), *range(0xDF, 0x100)] if c != 0xF7}

    @staticmethod
    def fits(spec: str) -> bool:
        d = json.loads(spec)
        kinds = [x["type"] for x in (d.get("normalizer") or {}).get("normalizers", [])]
        pre = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (kinds == ["NFC", "Replace", "Lowercase"] and len(pre) == 2 and pre[0].get("pattern") == {"Regex": WORDS}
                and pre[0].get("invert") and pre[0].get("behavior") == "Removed" and pre[1]["type"] == "ByteLevel" and not pre[1].get("use_regex")
                and not d.get("post_processor") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in d["added_tokens"])
                and all(t["content"].startswith("<|") for t in d["added_tokens"]))

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self._encode(word)
        if len(word) <= 64:
            if len(self) >= self.REMEMBER:
                self.old = dict(self)
                self.clear()
                self[""] = b""
            self[word] = got
        return got

    def _encode(self, word: str) -> bytes:
        if word[-1] in ".,;:!?" and word[-2:-1].isalnum():  # letters and digits never join punctuation after them
            return self[word[:-1]] + self[word[-1]] if "<|" not in word else self._whole(word)
        if _LATIN.fullmatch(word):  # one word of the pattern, composed letters
            return array(self.code, [t.id for t in self.model.tokenize(word.translate(self.bytes))]).tobytes()
        if "<|" not in word:  # no special token inside
            core = word.rstrip(_PUNCTUATION)
            if core and len(core) < len(word) and core[-1].isalnum():
                return self[core] + self[word[len(core):]]
            low = word.lower()
            if low != word and len(low) == len(word) and _LATIN.fullmatch(low):
                return self[low]
        return self._whole(word)

    def _whole(self, word: str) -> bytes:
        return array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class TextIds:
    """Any other tokenizer: whole texts."""

    def __init__(self, spec: str, kind: str = "<u4"):
        from tokenizers import Tokenizer

        self.kind, self.tokenizer = kind, Tokenizer.from_str(spec)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


class Vocabulary:
    """A tokenizer's JSON, as broadcast; the encoder made from it lives as long as the worker."""

    def __init__(self, spec: str, end_id: int):
        d = json.loads(spec)
        self.spec, self.end_id, self._encoder = spec, end_id, None
        self.size = max([0, end_id, *d["model"]["vocab"].values(), *[t["id"] for t in d["added_tokens"]]]) + 1
        #: two bytes an id on the way to the writer, where they suffice
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"

    def __getstate__(self):
        return self.__dict__ | {"_encoder": None}

    def encoder(self):
        if self._encoder is None:
            self._encoder = (WordIds if WordIds.fits(self.spec) else TextIds)(self.spec, self.kind)
        return self._encoder


def token_rows(rows: DataFrame, spec: str, end_id: int) -> DataFrame:
    """(row, doc_id, n, ids) of (row, doc_id, text), and per task one row (null row) with its id counts."""
    send = rows.sparkSession.sparkContext.broadcast(Vocabulary(spec, end_id))  # the tokenizer file

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v = send.value
        ids_of, end, width = v.encoder(), np.array([v.end_id], v.kind).tobytes(), int(v.kind[-1])
        total, names, doc_type = np.zeros(v.size, np.int64), ["row", "doc_id", "n", "ids", "counts"], None
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                doc_type = batch.column("doc_id").type
                got = [ids_of.encode(t or "") + end for t in batch.column("text").to_pylist()]
                total += np.bincount(np.frombuffer(b"".join(got), v.kind), minlength=v.size)
                n = np.array([len(g) // width for g in got], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n), pa.array(got, pa.binary()), pa.nulls(len(got), pa.binary())], names)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, doc_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                              pa.array([np.stack([np.flatnonzero(total), total[total > 0]]).tobytes()], pa.binary())], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row bigint, doc_id {kind}, n bigint, ids binary, counts binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Global counts of ids: grouped sums of the tasks' counts, one row per id in use."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for c in batch.column("counts").to_pylist():
                both = np.frombuffer(c, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["id", "n"])

    got = tokens.filter("counts is not null").select("counts").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = got["id"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    out[ids] = n
    return out


# --- files -----------------------------------------------------------------------------------

def write_ids(docs: DataFrame, spec: str, path: str, end_id: int = 1) -> None:
    """Encode every text with the tokenizer ``spec`` (its JSON), append ``end_id`` and write the data set.

    Needs columns doc_id and text; others are ignored.  Null text is empty: the end id alone.
    Rows that repeat a doc_id follow each other (see ``with_row_key``); a null doc_id comes last."""
    spark = docs.sparkSession
    rows = with_row_key(docs.select("doc_id", "text"), "row")
    tokens = stage(token_rows(rows, spec, end_id), "tokens")
    counts = id_counts(tokens)
    limit = max(LIMIT, int(np.ceil(np.log2(max(2, np.count_nonzero(counts))))))
    if limit > MAX_LIMIT:
        raise ValueError("vocabulary too large for the decoding table")
    lengths = code_lengths(counts, limit)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i]), limit) for i in used], "id int, length int, max_bits int").coalesce(1).write.parquet(f"{path}/codes")

    body = tokens.filter("row is not null").select("row", "doc_id", "n", "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = range_points(body, "row", parts)
    bucket, keys = bucket_of(points), even_keys(spark, len(points) + 1)
    dealt = body.withColumn("file", bucket("row")).withColumn("route", F.get(F.lit(keys), F.col("file")))
    dealt = dealt.repartition(len(keys), "route").sortWithinPartitions("file", "row")
    send = spark.sparkContext.broadcast((codes, lengths))  # one entry per id of the vocabulary

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codes, lengths = send.value
        names = ["file", "block", "first", "doc_ids", "counts", "lanes", "bits"]
        file, block, first, doc_ids, counts, held, have = None, 0, 0, [], [], [], 0

        def flush(kind):
            nonlocal block, first, doc_ids, counts, held, have
            ids = np.concatenate(held)
            bits, lanes = pack(ids, codes, lengths)
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()),
                                              pa.array([doc_ids], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())),
                                              pa.array([lanes.astype("<u2").tobytes()], pa.binary()), pa.array([bits], pa.binary())], names)
            block, first, doc_ids, counts, held, have = block + 1, first + len(ids), [], [], [], 0

        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            for f, d, n, raw in zip(*[batch.column(c).to_pylist() for c in ("file", "doc_id", "n", "ids")], strict=True):
                if f != file:
                    if held:
                        yield from flush(kind)
                    file, block, first = f, 0, 0
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)
                doc_ids.append(d)
                counts.append(n)
                held.append(ids.astype(np.int64))
                have += n
                if have >= BLOCK_IDS:
                    yield from flush(kind)
        if held:
            yield from flush(kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"file int, block bigint, first bigint, doc_ids array<{kind}>, counts array<bigint>, lanes binary, bits binary"
    dealt.select("file", "doc_id", "n", "ids").mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(tokens)


def read_ids(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """Read a data set back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    Blocks decode independently, so they may be read in any order and by any task."""
    blocks = spark.read.parquet(f"{path}/blocks")
    codes = spark.read.parquet(f"{path}/codes").toArrow()  # one row per id of the vocabulary in use
    limit = int(codes["max_bits"][0].as_py()) if len(codes) else LIMIT
    lengths = np.zeros(max(codes["id"].to_pylist(), default=0) + 1, np.uint8)
    lengths[codes["id"].to_numpy()] = codes["length"].to_numpy()
    send = spark.sparkContext.broadcast(lengths)
    # ids before each file: a running sum over one row per file
    size = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    files = blocks.select("file", size.alias("n")).groupBy("file").agg(F.sum("n").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        table = decode_table(send.value, limit)
        for whole in batches:
            for batch in slices(whole, "bits", 2 << 20):
                counts = [np.array(c, np.int64) for c in batch.column("counts").to_pylist()]
                sizes = [int(c.sum()) for c in counts]
                lanes = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column("lanes").to_pylist()]
                ids = unpack(batch.column("bits").to_pylist(), lanes, sizes, table, limit).astype("<u4")
                n = np.concatenate(counts)
                ends = np.concatenate([[0], np.cumsum(n)])
                base = batch.column("base").to_numpy() + batch.column("first").to_numpy()
                start = np.concatenate([b + np.cumsum(c) - c for b, c in zip(base, counts, strict=True)])
                raw, at = memoryview(ids.tobytes()), ends.tolist()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at, at[1:])]
                cols = [batch.column("doc_ids").flatten(), pa.array(start), pa.array(n), pa.array(crc, pa.int64())]
                if not digest_only:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])

    rows = blocks.join(F.broadcast(files), "file")  # one row per file
    return rows.select("base", "first", "doc_ids", "counts", "lanes", "bits").mapInArrow(
        run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ("" if digest_only else ", ids array<int>"))


def round_trip(docs: DataFrame, spec: str, end_id: int = 1) -> DataFrame:
    """Write to a folder of the shared directory and read the digests back."""
    spark = docs.sparkSession
    path = scratch_path(spark, f"llm/ids-{uuid.uuid4().hex}")
    write_ids(docs, spec, path, end_id)
    return read_ids(spark, path, digest_only=True)
