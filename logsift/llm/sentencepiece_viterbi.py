"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation of a text maximises the sum of its pieces' scores.  The search keeps
the scores of at most ``max piece length`` positions ahead; whenever every surviving
backpointer path runs through one boundary, the ids up to it are committed and forgotten.
Scores are integers, so the committed ids equal those of a search over the whole text.

No piece holds a space after another character, so each space that starts a word is such
a boundary: words between them are searched once and remembered in a bounded table.

A model of BPE type ranks its pieces by merge order instead of giving probabilities; Zipf's
law turns rank r into the unigram score -log(r + 2.7).  Models of unigram type keep their scores.
Characters outside the vocabulary become their UTF-8 byte pieces, so every text decodes to itself.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SCALE = 1 << 20
ZIPF_SHIFT = 2.7
UNKNOWN_PENALTY = 10.0
MARK = "▁"
#: Segments remembered (twice as many at most), and their largest length; portions of long ones.
REMEMBER, REMEMBER_LENGTH, PORTION = 250_000, 64, 4096


class Model:
    """Vocabulary as plain data (picklable): piece -> (score, id), every prefix of a piece -> no id."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int], dummy_prefix: bool = True):
        """``pieces``: (text with plain spaces, score, id); ``byte_ids``: id of each byte's piece."""
        self.texts = {i: t for t, _, i in pieces}
        self._root = self._encoder = None
        self.byte_ids, self.dummy_prefix = byte_ids, dummy_prefix
        low = min((s for _, s, _ in pieces), default=0.0)
        self.unknown = round((low - UNKNOWN_PENALTY) * SCALE)
        self.trie: dict[str, tuple[int, int] | None] = {}
        for text, _, _ in pieces:
            for k in range(1, len(text)):
                self.trie.setdefault(text[:k], None)
        for text, score, i in pieces:
            self.trie[text] = (round(score * SCALE), i)
        self.longest = max((len(t) for t, _, _ in pieces), default=1)
        #: neighbouring characters inside pieces; between any other two, every path has a boundary
        self.pairs = {t[k:k + 2] for t, _, _ in pieces for k in range(len(t) - 1)}
        #: a boundary before each word's space holds for all paths
        self.cut_at_spaces = not any(" " in t.lstrip(" ") for t, _, _ in pieces)
        self.cut_at_lines = not any("\n" in t and len(t) > 1 for t, _, _ in pieces)

    @classmethod
    def load(cls, path: str) -> Model:
        """Read a .model file on the driver; the model travels to the tasks as plain data."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "a  Bé ﬁ\n"
        if sp.normalize(probe).lstrip(MARK) != probe.replace(" ", MARK):
            raise ValueError("only models whose normalisation leaves characters and spaces as they are")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no byte pieces")
        scores = {i: sp.get_score(i) for i in plain}
        # merge ranks are whole numbers 0, -1, -2, ...; log probabilities aren't
        if all(s == int(s) for s in scores.values()):
            scores = {i: -math.log(ZIPF_SHIFT - s) for i, s in scores.items()}
        return cls([(sp.id_to_piece(i).replace(MARK, " "), scores[i], i) for i in plain], byte_ids,
                   sp.normalize("a") != "a")

    def root(self) -> dict:
        """The pieces as nested tables: character -> (next table, score, id or -1)."""
        if self._root is None:
            tables: dict[str, dict] = {"": {}}
            for prefix, hit in sorted(self.trie.items()):  # a prefix sorts before what it starts
                tables[prefix] = {}
                tables[prefix[:-1]][prefix[-1]] = (tables[prefix], *(hit or (0, -1)))
            self._root = tables[""]
        return self._root

    def __getstate__(self):
        return self.__dict__ | {"_root": None, "_encoder": None}

    def encoder(self) -> Encoder:
        """The worker's encoder: a broadcast model lives as long as the worker, and so does what it remembers."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def table(self) -> list[bytes]:
        """Bytes of each id."""
        size = max([*self.texts, *self.byte_ids], default=-1) + 1
        out = [b""] * size
        for i, t in self.texts.items():
            out[i] = t.encode("utf-8", "surrogatepass")
        for b, i in enumerate(self.byte_ids):
            out[i] = bytes([b])
        return out


class Stream:
    """Streaming search: ``feed`` text in any portions, ``finish``; both return committed ids.

    Between calls only the positions after the last committed boundary are kept; ``widest`` is
    the most positions that held state at once, a portion's own included."""

    def __init__(self, model: Model):
        self.m, self.text, self.widest = model, "", 0
        self.score: list[int | None] = [0]  # of positions from the last committed boundary on
        self.back: list[int] = [0]
        self.ids: list[int] = [0]
        self.at = self.reach = 0  # next position to extend, furthest position that a piece reaches

    def feed(self, more: str) -> list[int]:
        self.text += more
        return self._run(len(self.text) - self.m.longest + 1, False)

    def finish(self) -> list[int]:
        return self._run(len(self.text), True)

    def _run(self, end: int, last: bool) -> list[int]:
        root, unknown, longest, out, lo = self.m.root(), self.m.unknown, self.m.longest, [], 0
        text, score, back, ids, i, reach = self.text, self.score, self.back, self.ids, self.at, self.reach
        n = len(text)
        if n >= len(score):
            more = n + 1 - len(score)
            score += [None] * more
            back += [0] * more
            ids += [0] * more
        while i < end:
            if i == reach:  # no piece passes this boundary
                if i > lo:
                    self._path(i, lo, out)
                    lo = i
            elif i - lo >= 4 * longest and (i - lo) % longest == 0 and (c := self._meet(i, reach)) > lo:
                self._path(c, lo, out)
                lo = c
            base = score[i]
            if base is not None:
                node, k, single = root, i, False
                while k < n:
                    hit = node.get(text[k])
                    if hit is None:
                        break
                    node, s, piece = hit
                    k += 1
                    if piece >= 0:
                        if k == i + 1:
                            single = True
                        s += base
                        was = score[k]
                        if was is None or s > was:
                            score[k], back[k], ids[k] = s, i, piece
                            if k > reach:
                                reach = k
                if not single:
                    k, s = i + 1, base + unknown
                    was = score[k]
                    if was is None or s > was:
                        score[k], back[k], ids[k] = s, i, -1
                        if k > reach:
                            reach = k
            i += 1
        self.widest = max(self.widest, len(score))
        if last:
            self._path(n, lo, out)
        else:  # forget what is committed
            zero = score[lo]
            self.score = [None if s is None else s - zero for s in score[lo:]]
            self.back, self.ids, self.text = [b - lo for b in back[lo:]], ids[lo:], text[lo:]
            self.at, self.reach = i - lo, reach - lo
        return out

    def _meet(self, i: int, reach: int) -> int:
        """The last boundary that the best paths of all live positions share."""
        live = {k for k in range(i, reach + 1) if self.score[k] is not None}
        while len(live) > 1:
            k = max(live)
            live.discard(k)
            live.add(self.back[k])
        return live.pop()

    def _path(self, c: int, lo: int, out: list[int]) -> None:
        """Append the best path from boundary ``lo`` to boundary ``c``."""
        got, k = [], c
        while k > lo:
            j = self.back[k]
            if self.ids[k] < 0:
                got.extend(self.m.byte_ids[b] for b in reversed(self.text[j:k].encode("utf-8", "surrogatepass")))
            else:
                got.append(self.ids[k])
            k = j
        got.reverse()
        out += got


class Encoder(dict):
    """Segment -> its ids as little-endian 32-bit bytes; a bounded memory of segments seen."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, segment: str) -> bytes:
        got = self.old.get(segment)
        if got is None:
            got = self._search(segment)
        if len(segment) <= REMEMBER_LENGTH:
            if len(self) >= REMEMBER:  # what was not used since the last turn is forgotten
                self.old = dict(self)
                self.clear()
            self[segment] = got
        return got

    def _search(self, segment: str) -> bytes:
        pairs = self.model.pairs
        if len(segment) > 1:
            cuts = [k for k in range(1, len(segment)) if segment[k - 1:k + 1] not in pairs]
            if cuts:
                return b"".join([self[segment[a:b]] for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True)])
        stream, ids = Stream(self.model), []
        for at in range(0, len(segment) - PORTION, PORTION):
            ids += stream.feed(segment[at:at + PORTION])
        stream.text += segment[(len(segment) - 1) // PORTION * PORTION:]
        return array("i", ids + stream.finish()).tobytes()

    def segments(self, text: str) -> Iterable[str]:
        """Cut where every path has a boundary: before a word's space, around a line end."""
        import re

        if self.model.dummy_prefix and text:
            text = " " + text
        if not self.model.cut_at_spaces:
            return [text] if text else []
        if not self.model.cut_at_lines:
            return re.findall(r" +[^ ]*|[^ ]+", text)
        if "  " in text:
            return re.findall(r"\n| +[^ \n]*|[^ \n]+", text)
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + w for w in rest]
        return out

    def encode(self, text: str) -> bytes:
        return b"".join([self[s] for s in self.segments(text)])


def decode(ids: Iterable[int], table: list[bytes], dummy_prefix: bool = True) -> str:
    raw = b"".join([table[i] for i in ids])
    return raw[dummy_prefix and raw[:1] == b" ":].decode("utf-8", "replace")


def encode_decode(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, ids, n_ids, decoded.

    Null text counts as empty text, which has no ids.  Rows are independent: repeated rows
    give repeated results, a null doc_id stays null, an empty table gives an empty result, and
    other columns are ignored.  Long texts are searched in portions; nothing is cut off."""
    send = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary: tens of thousands of pieces, whatever the data

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder, pieces = send.value.encoder(), send.value.table()
        prefix = send.value.dummy_prefix
        for whole in batches:
            for batch in slices(whole, "text"):
                got = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0] + [len(g) // 4 for g in got], dtype=np.int64)
                ids = np.frombuffer(b"".join(got), np.int32)
                plain = ids.tolist()
                back = [decode(plain[a:b], pieces, prefix) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                     pa.array(np.diff(ends)), pa.array(back, pa.string())], ["doc_id", "ids", "n_ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_ids bigint, decoded string")


def coded(docs: DataFrame, model: Model) -> DataFrame:
    """``encode_decode`` with the decoded text as digest and round trip check."""
    out = encode_decode(docs, model)
    return out.select("doc_id", "ids", "n_ids", F.sha2("decoded", 256).alias("decoded_sha256"))
