"""Fingerprints, ids, pieces, licence scan, chat rendering: against brute force and round trips."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

cdc = pytest.importorskip("logsift.llm.cdc")
from logsift.llm import chat_render, huffman, license_join, queries  # noqa: E402
from logsift.llm import sentencepiece_viterbi as sv  # noqa: E402

WORDS = ["alpha", "beta", "gamma", "delta", "Ünïcode", "the", "of", "日本語"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


ODD = [(1, None), (2, ""), (3, " "), (4, "one"), (5, prose(5, 20_000)), (6, "one"), (7, "a\tb\r\n\x0bc  d"), (8, prose(8, 300)), (9, prose(8, 300) + " end")]


def odd_docs(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    # extra columns whose names clash with the operators' own
    return df.withColumns({c: F.lit("x") for c in ("row", "size", "label", "n", "bucket", "ids", "fingerprint", "kept", "target")}).repartition(3)


@pytest.fixture(scope="module")
def model():
    return sv.Model.load(queries.tokenizer_file(queries.PIECES))


# --- 2: fingerprints -------------------------------------------------------------------------

def slow_cuts(raw, gear):
    out, at, h, hashes = [], 0, 0, []
    for b in raw:
        h = ((h << 1) + int(gear[b])) & 0xFFFFFFFF
        hashes.append(h)
    while at < len(raw):
        end = min(at + cdc.LARGEST, len(raw))
        for p in range(at + cdc.SMALLEST - 1, end):
            bits = cdc.STRICT_BITS if p < at + cdc.USUAL - 1 else cdc.LOOSE_BITS
            if hashes[p] >> (32 - bits) == 0:
                end = p + 1
                break
        out.append(end)
        at = end
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=1200), min_size=1, max_size=4))
def test_cuts_equal_byte_by_byte_hash(raw):
    gear = cdc._gear()
    assert cdc.cut(raw, gear) == [slow_cuts(r, gear) for r in raw]


def test_insertion_touches_few_chunks():
    gear, text = cdc._gear(), prose(1, 3000)
    a, b = cdc.fingerprints([text, text[:4000] + "inserted" + text[4000:]], gear)
    assert cdc.containment(a, b) > 0.95
    assert cdc.containment(a, cdc.fingerprints([prose(2, 3000)], gear)[0]) < 0.2
    assert cdc.containment({}, {}) == 1 and cdc.containment(a, {}) == 0 == cdc.containment({}, a)


def expected_neighbours(rows):
    rows = [(i, t or "") for i, t in rows]
    gear = cdc._gear()
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        a, b, c = cdc.fingerprints([t, e, nxt], gear)
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), cdc.as_text(a), cdc.as_text(b), cdc.containment(a, b), cdc.containment(a, c))
    return out


def test_neighbours(spark):
    got = {r[0]: tuple(r[1:]) for r in cdc.compare_neighbours(odd_docs(spark)).collect()}
    assert got == expected_neighbours(ODD)


def test_neighbours_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert cdc.compare_neighbours(empty).count() == 0
    one = cdc.compare_neighbours(spark.createDataFrame([(7, "abcd")], empty.schema)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abca").hexdigest()
    twice = spark.createDataFrame([(1, "abcd"), (1, "abcd"), (None, "x"), (0, None)], empty.schema)
    assert sorted(r.n_chars for r in cdc.compare_neighbours(twice).collect()) == [0, 1, 4, 4]


def test_document_chunks_cover_text(spark):
    for r in cdc.document_fingerprints(odd_docs(spark)).collect():
        assert sum(c.length for c in r.chunks) == r.n_bytes and all(c.length <= cdc.LARGEST for c in r.chunks)


# --- 3: ids ----------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(9, 16), st.randoms())
def test_huffman_round_trip(counts, limit, rnd):
    counts = np.array(counts)
    counts[rnd.randrange(len(counts))] += 1
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= limit and (len(used) == 1 or (2.0 ** -used).sum() == 1)
    codes = huffman.canonical(lengths)
    ids = np.array([rnd.choice(np.flatnonzero(lengths).tolist()) for _ in range(rnd.randrange(1, 500))])
    blocks = [ids, ids[:65], ids[:1]]
    packed = [huffman.pack(b, codes, lengths) for b in blocks]
    got = huffman.unpack([p[0] for p in packed], [p[1] for p in packed], [len(b) for b in blocks], huffman.decode_table(lengths, limit), limit)
    assert (got == np.concatenate(blocks)).all()


def test_code_lengths_are_optimal():
    import heapq

    counts = (np.random.default_rng(0).pareto(1.0, 500) * 9).astype(np.int64) + 1
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert (huffman.code_lengths(counts, 30) * counts).sum() == total


SPEC = queries.tokenizer_file(queries.WORD_BPE)


def test_words_one_by_one_equal_whole_texts():
    spec = open(SPEC, encoding="utf-8").read()
    assert huffman.WordIds.fits(spec)
    words = huffman.WordIds(spec)
    texts = ["<|endoftext|> hi<|endoftext|>.", "don't we'll it's. 'S O'Neil's...", "ΣΑΣ İstanbul ½x ä .̈", "a\tb\r\nc\x85d e \x1cf",
             "n.a.s.a. 3.14,15 日本語。テスト！ Œuvre ÿŸ µ ª", "x<|y foo|>", "é.  ́a", "", "  ", *[t for _, t in ODD if t]]
    for t in texts:
        assert np.frombuffer(words.encode(t), np.uint32).tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def test_id_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    spec = open(SPEC, encoding="utf-8").read()
    tok = Tokenizer.from_str(spec)
    huffman.write_ids(odd_docs(spark), spec, str(tmp_path / "ids"), end_id=1)
    got, at = {r.doc_id: r for r in huffman.read_ids(spark, str(tmp_path / "ids")).collect()}, 0
    assert len(got) == len(ODD)
    for i, t in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (at, len(ids), ids)
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_id_files_empty_table(spark):
    spec = open(SPEC, encoding="utf-8").read()
    assert huffman.round_trip(spark.createDataFrame([], "doc_id bigint, text string"), spec).count() == 0


# --- 1: pieces -------------------------------------------------------------------------------

def full_viterbi(m, s):
    """Whole-text search; the same tie rule (first start wins)."""
    best, back = [0] + [None] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        if best[i] is None:
            continue
        options = [(k, m.trie[s[i:k]]) for k in range(i + 1, min(len(s), i + m.longest) + 1) if m.trie.get(s[i:k])]
        if not any(k == i + 1 for k, _ in options):
            options.append((i + 1, (m.unknown, -1)))
        for k, (score, i_) in options:
            if best[k] is None or best[i] + score > best[k]:
                best[k], back[k] = best[i] + score, (i, i_)
    out, k = [], len(s)
    while k:
        i, i_ = back[k]
        out[:0] = [i_] if i_ >= 0 else [m.byte_ids[b] for b in s[i:k].encode()]
        k = i
    return out


def toy(pieces):
    return sv.Model([(p, s, 256 + k) for k, (p, s) in enumerate(pieces)], list(range(256)))


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", max_size=300), st.integers(1, 40))
def test_streaming_equals_whole_search(text, portion):
    m = toy([("a", -2.0), ("b", -2.5), ("ab", -2.2), ("aab", -3.0), ("aaaa", -3.1), (" a", -1.5), ("ba", -3.9), (" ", -1.0), ("  ", -1.2), ("c a", -2.0)])
    stream, got = sv.Stream(m), []
    for at in range(0, len(text), portion):
        got += stream.feed(text[at:at + portion])
    got += stream.finish()
    assert got == full_viterbi(m, text)
    enc = sv.Encoder(m)
    assert np.frombuffer(enc.encode(text), np.int32).tolist() == (full_viterbi(m, " " + text) if text else [])


def test_window_stays_bounded():
    m = toy([("a", -2.0), ("aa", -3.0), ("aaa", -4.5), ("b", -1.0)])
    stream = sv.Stream(m)
    n = sum(len(stream.feed("a" * 50 + "b")) for _ in range(400)) + len(stream.finish())
    # paths of unlike parity meet at each b only, so one portion may wait for the next
    assert n > 400 and stream.widest <= 2 * 51 + 6 * m.longest


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_decode_restores_text(model, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = np.frombuffer(sv.Encoder(model).encode(text), np.int32).tolist()
    assert sv.decode(ids, model.table()) == text
    assert ids == (full_viterbi(model, " " + text) if text else [])


def test_equals_the_library_on_the_same_scores(model):
    """The library's own search over the same vocabulary with the same scores, as a unigram model."""
    proto_lib = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    proto = proto_lib.ModelProto()
    proto.ParseFromString(open(queries.tokenizer_file(queries.PIECES), "rb").read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if i in model.texts:
            p.score = model.trie[model.texts[i]][0] / sv.SCALE
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    enc, same, n = sv.Encoder(model), 0, 0
    value = lambda ids: sum(model.trie[model.texts[i]][0] if i in model.texts else model.unknown for i in ids)
    for seed in range(40):
        rng = np.random.default_rng(seed)
        text = " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 12))) for _ in range(40))
        mine, theirs = np.frombuffer(enc.encode(text), np.int32).tolist(), lib.encode(text)
        assert value(mine) >= value(theirs)
        same, n = same + (mine == theirs), n + 1
    assert same >= 0.9 * n  # the library adds in single precision, which breaks near ties its own way


def test_encode_decode_rows(spark, model):
    got = {r.doc_id: r for r in sv.encode_decode(odd_docs(spark), model).collect()}
    assert {i: got[i].decoded for i, _ in ODD} == {i: t or "" for i, t in ODD}
    assert got[1].ids == [] and got[4].ids == got[6].ids and got[5].n_ids == len(got[5].ids)
    assert sv.encode_decode(spark.createDataFrame([], "doc_id bigint, text string"), model).count() == 0


# --- 7: licence scan -------------------------------------------------------------------------

def slow_matches(words, t):
    """Every window of every template, counted from scratch."""
    size = min(t.window, len(words))
    return {s for s in range(len(words) - size + 1) if len(set(words[s:s + size]) & set(t.words)) >= t.need} if len(words) >= t.need else set()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a b c d e f g h x y z".split()), max_size=60), st.floats(0.5, 1.0))
def test_scan_finds_every_matching_window(words, threshold):
    words = [w.encode() for w in words]
    templates = license_join.ordered_templates([("one", "a b c d e"), ("two", "c f g h a b d e"), ("dup", "a a b")], {b"a": 5, b"b": 2}, threshold)
    got = license_join.Scanner(templates, [("b c", "base")]).scan(words)
    for t in templates:
        hits, places = slow_matches(words, t), [p for p in got if p[0] == "template" and p[1] == t.label]
        assert bool(hits) == bool(places)
        size, spans = min(t.window, len(words)), sorted((p[2], p[3]) for p in places)
        assert all(a < b <= c for (a, b), (c, _) in zip(spans, [*spans[1:], (10**9, 0)]))  # disjoint
        assert all(any(a < start + size and start < b for a, b in spans) for start in hits)  # each matching window overlaps one
        for _, _, a, b, score in places:
            assert score == len(set(words[a:b]) & set(t.words)) / len(t.words) >= t.need / len(t.words)
        if hits:
            assert max(p[4] for p in places) == max(len(set(words[s:s + size]) & set(t.words)) for s in hits) / len(t.words)
    assert sorted(p[2] for p in got if p[0] == "base") == [i for i in range(len(words) - 1) if words[i:i + 2] == [b"b", b"c"]]


@pytest.mark.parametrize("label, text", [(x, y) for x, y in license_join.TEMPLATES if len(license_join.words_of(y)) > 5])
@pytest.mark.parametrize("gap", [0, 1, 12])
def test_repeated_notices_all_count(label, text, gap):
    notice = license_join.words_of(text)
    scanner = license_join.Scanner(license_join.ordered_templates([(label, text)], {}, 0.9), [])
    for times in (1, 2, 3, 50, 1000):
        words = [b"w"] * 5 + (notice + [b"x"] * gap) * times + [b"w"] * 3
        got = scanner.scan(words)
        assert [p[2] for p in got] == [5 + k * (len(notice) + gap) for k in range(times)] and {p[4] for p in got} == {1.0}
        assert all(p[3] - p[2] == len(notice) for p in got)


def test_scan_rows(spark):
    notice = "Hello. This work is licensed under the GNU\nGeneral Public License, version 3. All rights reserved. All rights RESERVED"
    rows = [(1, notice), (2, None), (3, ""), (4, "Licensed under CC BY 4.0"), (5, "released under the mit licence"), (6, "x " * 5000 + "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("places", F.lit(1))
    got = {r.doc_id: r for r in license_join.scan(df).collect()}
    base = lambda i: sorted((p.label, p.start) for p in got[i].places if p.kind == "base")
    labels = lambda i: {p.label for p in got[i].places}
    assert base(1) == [("gpl", 8), ("reserved", 13), ("reserved", 16)] and "gpl" in {p.label for p in got[1].places if p.kind == "template"}
    assert got[2].n_words == 0 == got[3].n_words and not got[2].places and not got[5].places
    assert base(4) == [("cc-by", 2)] and labels(6) == {"mit"} and got[6].places[0].start == 5000
    assert license_join.scan(df.filter("false")).count() == 0


# --- 6: chat ---------------------------------------------------------------------------------

T = chat_render.MarkedTemplate()
TRICKY = st.text(st.sampled_from(list("[]<>/\\INSTROLE s\n|")), max_size=25)


@settings(max_examples=200, deadline=None)
@given(TRICKY, st.lists(st.sampled_from([*T.MARKS, "\\", "a", "<", "["]), max_size=6).map("".join))
def test_escape_is_reversible(a, b):
    for text in (a, b, a + b):
        assert T.unescape(T.escape(text)) == text and not any(m in T.escape(text) for m in T.MARKS)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<<ROLE>>"]), TRICKY), max_size=9))
def test_spans_read_back(turns):
    f = chat_render.format_turns(T.render, turns)
    assert f.text == T.render(turns) and not f.rewrites
    assert [(T.read_role(f.text[s:a]), T.unescape(f.text[a:b])) for s, _, a, b in f.spans] == turns


def test_long_conversation_uses_windows():
    sizes = []

    def render(turns):
        sizes.append(len(turns))
        return "BOS" + T.render(turns)

    turns = [("user" if k % 2 else "assistant", f"text {k} [INST]") for k in range(500)]
    f = chat_render.format_turns(render, turns)
    assert f.text == "BOS" + T.render(turns) and max(sizes) <= chat_render.WINDOW
    assert [T.unescape(f.text[a:b]) for _, _, a, b in f.spans] == [t for _, t in turns]


def test_history_that_depends_on_all_turns_falls_back():
    render = lambda turns: "".join(f"<{k}:{t}>" for k, (_, t) in enumerate(turns))
    turns = [("user", f"t{k}") for k in range(150)]
    f = chat_render.format_turns(render, turns)
    assert f.text == render(turns) and [f.text[a:b] for _, _, a, b in f.spans] == [t for _, t in turns]


def test_dependence_on_more_turns_than_a_window_is_found(spark):
    class KeepsLast:
        def render(self, turns):
            return "".join(f"[{r}]{t};" for r, t in turns[-100:])

    turns = [("user", f"t{k}") for k in range(150)]
    late = lambda turns: "".join(f"[{r}]{t};" for r, t in turns if r != "system" or len(turns) < 90)
    blink = lambda turns: "".join(f"[{r}]{t};" for r, t in turns) + ("..." if len(turns) == 110 else "")
    with_system = [("system", "rules"), *turns]
    for render, said, rewrites in ((KeepsLast().render, turns, list(range(100, 150))), (late, with_system, [89]), (blink, turns, [110])):
        f = chat_render.format_turns(render, said, whole_prefixes=True)
        assert f.text == render(said) and f.rewrites == rewrites
        assert all(s is None or f.text[s[2]:s[3]] == t for s, (_, t) in zip(f.spans, said, strict=True))
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    got = chat_render.format_conversations(df, KeepsLast()).first()
    assert got.formatted == KeepsLast().render(turns) and got.rewrites == list(range(100, 150))
    assert [s is None for s in got.spans] == [True] * 50 + [False] * 100


def test_rewritten_history_is_detected():
    """A template that shows an assistant's words only while they are the last."""
    render = lambda turns: "".join(f"[{r}]{t}" if r == "user" or k == len(turns) - 1 else f"[{r}]" for k, (r, t) in enumerate(turns))
    turns = [("user", "hi"), ("assistant", "one"), ("user", "more"), ("assistant", "two")]
    f = chat_render.format_turns(render, turns)
    assert f.rewrites == [2] and f.text == render(turns) and f.spans[1] is None
    assert [f.text[s[2]:s[3]] for s in (f.spans[0], f.spans[2], f.spans[3])] == ["hi", "more", "two"]


def test_conversation_rows(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, "system", None), (2, None, None, "late"), (None, 0, "user", "x"), (1, 1, "assistant", "b</s>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("spans", F.lit(0))
    got = {r.conv_id: r for r in chat_render.read_back(chat_render.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (3, sha("user\na\nassistant\nb</s>\nassistant\nb</s>\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (10, sha("b</s>b</s>"))
    assert got[2].turns_sha256 == sha("system\n\n\nlate\n") and got[2].loss_sha256 == sha("") and got[None].n_turns == 1
    assert chat_render.format_conversations(df.filter("false")).count() == 0


def test_words_pattern_matches_code_points():
    text = "".join(map(chr, range(0, 0x180))) + "日本 x"
    low = text.translate({c: c + 32 for c in range(65, 91)})
    assert [w.decode() for w in license_join.words_of(text)] == re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
