"""Hard negatives, exact vector search and ranked lexical search: against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

hard_negatives = pytest.importorskip("logsift.llm.hard_negatives")
from logsift.llm import best_position, max_score, vector_cells  # noqa: E402

VECTORS = "vec_id bigint, embedding array<float>, label int"
CLASH = ("id", "vec", "cell", "part", "rank", "score", "p", "positives", "query", "size", "place", "round", "terms", "n")


def clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


@pytest.fixture
def small_blocks(monkeypatch):
    """Many cells even for a small table: several query blocks, and merges in steps."""
    monkeypatch.setattr(vector_cells, "BLOCK_BYTES", 8 * 6 * 7)
    monkeypatch.setattr(vector_cells, "FAN", 3)
    monkeypatch.setattr(max_score, "CHUNK", 5)
    monkeypatch.setattr(hard_negatives, "ANCHOR_TILE", 2)
    monkeypatch.setattr(hard_negatives, "ROW_TILE", 3)


def vector_rows(n=90, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(np.round(rng.normal(size=dim), 1))], int(rng.integers(3))) for i in range(n)]
    rows += [(n + 1, None, 1), (None, [1.0] * dim, 1), (n + 2, [1.0, None], 0), (n + 3, [float("nan")] * dim, 0), (n + 4, [float("-inf"), 1.0], 0),
             (n + 5, [1.0] * dim, None), (n + 6, [], 1), (n + 7, [0.5], 2), (n + 8, [1.0] * (dim + 1), 0)]
    rows += [(200 + i, [0.1] * dim, i % 2) for i in range(30)]  # ties
    rows += [rows[3], rows[3], rows[10]]  # repeated rows, a query among them
    return rows


def whole(rows, scale, label):
    out = []
    for i, v, c in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (label and c is None):
            continue
        out.append((i, [math.floor(scale * x) for x in v], c))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def slow_top(rows, k, scale):
    used = whole(rows, scale, False)
    out = {}
    for q in sorted({i for i, *_ in used if i % 10 == 0}):
        v = min(v for i, v, _ in used if i == q)
        best = sorted((-dot(v, w), i) for i, w, _ in used if i != q)[:k]
        out.update({(q, r): (i, -s) for r, (s, i) in enumerate(best, 1)})
    return out


def slow_mine(rows, scale=256):
    used = whole(rows, scale, True)
    out = set()
    for a in sorted({i for i, *_ in used if i % 10 == 0}):
        c, v = min((c, v) for i, v, c in used if i == a)
        scored = sorted((-dot(v, w), i, d) for i, w, d in used if i != a)
        for s, i, _ in [x for x in scored if x[2] == c][:5]:
            near = [(t, j) for t, j, d in scored if d != c and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out |= {(a, i, r, j, -s, -t) for r, (t, j) in enumerate(near, 1)}
    return out


def test_strassen_is_the_product():
    rng = np.random.default_rng(0)
    for m, k, n in ((1, 1, 1), (5, 64, 7), (33, 34, 35), (64, 64, 64), (100, 3, 70), (71, 130, 97)):
        a, b = rng.integers(-2**62, 2**62, (m, k)), rng.integers(-2**62, 2**62, (k, n))
        for leaf in (1, 4, 32):
            if leaf > 1 or m * k * n < 30000:
                assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_by_brute_force(spark, small_blocks, seed):
    rows = vector_rows(seed=seed)
    df = clash(spark.createDataFrame(rows, VECTORS)).repartition(4)
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("label"), F.col("id") % 10 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_mine(rows) and len(got) > 100
    assert hard_negatives.mine(df.filter("false"), F.col("label"), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df.filter("label = 1"), F.col("label"), F.col("id") % 10 == 0).count() == 0


def test_negatives_in_one_cell_and_repeated_positives(spark):
    rows = vector_rows(300)
    got = {tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("label"), F.col("id") % 10 == 0).collect()}
    assert got == slow_mine(rows)
    twice = [(10, [1.0], 0), (1, [1.0], 0), (1, [1.0], 0), (2, [0.9], 1)]  # both copies of the positive count
    got = [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(twice, VECTORS), F.col("label"), F.col("id") % 10 == 0).collect()]
    assert got == [(10, 1, 1, 2, 65536, 256 * 230)] * 2


@pytest.mark.parametrize("seed", [1, 2])
def test_search_by_brute_force(spark, small_blocks, seed):
    rows = vector_rows(seed=seed)
    df = clash(spark.createDataFrame(rows, VECTORS)).repartition(4)
    got = max_score.top_k(df, F.col("id") % 10 == 0, 7).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == slow_top(rows, 7, 1024) and len(got) > 50
    assert max_score.top_k(df.filter("false"), F.col("id") % 10 == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0], 0), (5, [-1.0], 0)], VECTORS)  # a negative score is still the highest
    assert [tuple(r) for r in max_score.top_k(lone, F.col("id") % 10 == 0).collect()] == [(0, 1, 5, -1024 * 1024)]


def test_search_skips_what_cannot_win():
    rng = np.random.default_rng(3)
    sparse = rng.integers(1, 100, (4000, 40)) * (rng.random((4000, 40)) < 0.1)
    dense = rng.integers(-300, 300, (4000, 40))
    for rows, share in ((sparse, 0.5), (dense, 0.95)):
        query, ids = rows[0], np.arange(4000)
        heap, work = (np.empty(0, np.int64), np.empty(0, np.int64)), 0
        for at in range(0, 4000, 500):
            *heap, n = max_score.Chunk(ids[at:at + 500], rows[at:at + 500]).search(query, 0, *heap, 10)
            work += n
        scores = rows @ query
        want = sorted((-scores[i], i) for i in range(1, 4000))[:10]
        assert [(-s, i) for s, i in zip(*heap)] == want and work < share * 4000 * 40


# --- 13 --------------------------------------------------------------------------------------

def terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def slow_rank(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    total, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, b in bags:
            n = sum(b.values())
            m = 25 + 75 * n * total // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0 and doc is not None:
                scores.append((-s, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def lexical_rows():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcxyzé1Ñ"), 3)) for _ in range(60)]
    zipf = 1 / np.arange(1, 61)
    text = lambda n: " ".join(rng.choice(vocab, n, p=zipf / zipf.sum()))
    docs = [(int(i), text(int(rng.integers(1, 40)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, " .,;\n"), (None, text(20)), (403, "Rare\x00RARE rare　x İ K"), (404, text(30000))]
    docs += [(405 + i, "same words tie") for i in range(25)] + [(500, "abc " * 50), (500, "abc " * 50), docs[0]]
    items = [(int(i), text(12)) for i in range(12)] + [(20, None), (21, ""), (22, "unknownword"), (23, "TIE same, same!"), (23, "rare K İ"), (None, "rare x"), (24, text(300))]
    return docs, items


@pytest.mark.parametrize("shard, chars", [(16384, 1 << 22), (37, 200)])
def test_rank_by_brute_force(spark, shard, chars):
    docs, items = lexical_rows()
    d = clash(spark.createDataFrame(docs, "doc_id bigint, text string")).repartition(3)
    i = clash(spark.createDataFrame(items, "item_id int, text string")).repartition(2)
    got = sorted(((r.item_id if r.item_id is not None else -1), r["rank"], r.doc_id, r.score) for r in best_position.rank(d, i, 10, chars, shard).collect())
    want = slow_rank(docs, [(x if x is not None else -1, t) for x, t in items], 10)
    assert got == want and len(got) > 100
    if shard > 100:
        assert best_position.rank(d.filter("false"), i).count() == 0 == best_position.rank(d, i.filter("false")).count()
        assert best_position.rank(d, i).dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_search_stops_at_best_positions():
    rng = np.random.default_rng(7)
    n = 5000
    postings = [(t, d, int(rng.pareto(1.0) * 100) + 1) for t in range(4) for d in rng.choice(n, 2500, replace=False)]
    t, d, s = (np.array(x, np.int64) for x in zip(*postings))
    shard = best_position.Shard(t, d, s, np.arange(n))
    scores, ids, looked = shard.search({0: 1, 1: 2, 2: 1, 9: 1}, 10, np.empty(0, np.int64), np.empty(0, np.int64))
    total = np.zeros(n, np.int64)
    for term, times in ((0, 1), (1, 2), (2, 1)):
        np.add.at(total, d[t == term], times * s[t == term])
    assert list(zip(-scores, ids)) == sorted((-x, i) for i, x in enumerate(total))[:10]
    assert looked < n / 4
    # a floor from other shards stops it sooner
    assert shard.search({0: 1}, 1, np.array([10**9]), np.array([n + 1]))[2] <= best_position.FIRST_READ
