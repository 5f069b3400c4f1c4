"""Dedup, near dedup, mixing, language, urls and the pipeline: against brute force and held-out rows."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

radix_dedup = pytest.importorskip("logsift.llm.radix_dedup")
import corpus_pipeline  # noqa: E402
from logsift.llm import chosen_path, common, curriculum, language_fusion, shingles, url_words  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string"
CLASH = ("row", "keep_row", "n", "size", "root", "label", "node", "target", "copy", "position", "lt_row", "head", "bytes")


def clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


def words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n)]


# --- 4 ---------------------------------------------------------------------------------------

def exact_rows():
    long = " ".join(words(9000, 1))  # several radix rounds
    texts = [None, "", "a  b", "a\tb", "a b ", long, long + "x", long, "pre" * 40, "pre" * 40 + "\n\n", long.replace(" ", "\n"), "é", "é" * 64, "é" * 64]
    texts += ["copy " * 30] * 200 + ["copy " * 30 + f"{k}" for k in range(50)]
    return list(enumerate(texts, 10))


def test_classes_equal_grouping(spark):
    rows = exact_rows()
    df = clash(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {i: (min(g), len(g), i == min(g)) for g in groups.values() for i in g}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in radix_dedup.classify(df).collect()}
    assert got == want
    kept = radix_dedup.drop_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {min(g) for g in groups.values()}


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(3, "a"), (3, "a"), (None, "a"), (1, "b"), (None, "c"), (None, "c"), (3, "b")], "doc_id bigint, text string")
    got = radix_dedup.classify(df).collect()
    assert sorted((r.keep_id if r.keep_id is not None else -1, r.group_size) for r in got) == [(-1, 2)] * 2 + [(1, 2)] * 2 + [(3, 3)] * 3
    assert sum(r.kept for r in got) == 3 == radix_dedup.drop_copies(df).count()
    assert radix_dedup.classify(df.filter("false")).count() == 0


# --- 8 ---------------------------------------------------------------------------------------

def slow_sets(rows, width):
    out = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def slow_components(sets, num, den):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            same = len(sets[a] & sets[b])
            if den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_rows():
    rng = np.random.default_rng(3)
    rows, i = [], 0
    common_part = words(30, 99)
    for g in range(60):
        base = words(int(rng.integers(20, 150)), 1000 + g) + (common_part if g % 3 == 0 else [])
        for _ in range(int(rng.integers(1, 5))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = words(1, int(rng.integers(1e9)))[0]
            rows.append((i, " ".join(w)))
            i += 1
    hot = words(120, 7)  # one dense group beyond the size of a small node
    for _ in range(150):
        w = list(hot)
        w[int(rng.integers(len(w)))] = words(1, int(rng.integers(1e9)))[0]
        rows.append((i, " ".join(w)))
        i += 1
    chain = words(100, 8)
    for k in range(90):  # a chain: neighbours are alike, its ends share nothing
        rows.append((i, " ".join(chain[k:] + words(k, 555))))
        i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, "A b"), (i + 3, "a B"), (i + 4, "one"), (i + 5, " \n")]


@pytest.fixture(scope="module")
def near():
    return near_rows()


def test_shingle_sets_equal_python_sets(near):
    for width in (1, 3, 5):
        fast = shingles.shingle_sets([t for _, t in near], width)
        slow = list(slow_sets(near, width).values())
        assert [len(s) for s in fast] == [len(s) for s in slow]
        for a, b in itertools.islice(itertools.combinations(range(len(slow)), 2), 0, None, 97):
            assert len(np.intersect1d(fast[a], fast[b])) == len(slow[a] & slow[b])


def test_near_components_equal_all_pairs(spark, near, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 8)  # so that pivots, labels and deeper levels take part
    want = slow_components(slow_sets(near, 3), 85, 100)
    df = clash(spark.createDataFrame(near, "doc_id bigint, text string")).repartition(4)
    got = {r.doc_id: r for r in chosen_path.classes(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in slow_sets(near, 3).items()}
    assert {i for i, r in got.items() if r.kept} == set(want.values())


def test_parity_bits_never_exceed_the_difference(spark):
    rng = np.random.default_rng(4)
    sets = [rng.integers(-2**63, 2**63, n) for n in (1, 2, 16, 17, 32, 33, 60, 64, 65, 70, 128, 129, 130, 300)]
    sets += [np.unique(np.concatenate([s[k:], rng.integers(-2**63, 2**63, k)])) for s in sets for k in (1, len(s) // 5)]
    words = [chosen_path.parity_bits(np.unique(s).view(np.uint64)).tolist() for s in sets]
    assert [len(w) for w in words[:6]] == [1, 1, 1, 2, 2, 4]
    bits = spark.createDataFrame(list(enumerate(words)), "row bigint, bits array<bigint>")
    other = bits.select(F.col("row").alias("row2"), F.col("bits").alias("bits2"))
    got = bits.crossJoin(other).select("row", "row2", chosen_path.least_different("bits", "bits2").alias("least")).collect()
    tight = 0
    for r in got:
        differ = len(np.setxor1d(sets[r.row], sets[r.row2]))
        assert r.least <= differ and (r.row != r.row2 or r.least == 0)
        tight += r.least >= 0.7 * differ > 0
    assert tight > 100


def test_near_copies_below_the_threshold_pair_hardly_ever(spark):
    """A dense group: 80 near copies of one text at some 0.8 of each other, and two that are links."""
    rng = np.random.default_rng(6)
    base = rng.integers(-2**63, 2**63, 150)
    sets = []
    for _ in range(80):
        s = base.copy()
        s[rng.choice(150, 9, replace=False)] = rng.integers(-2**63, 2**63, 9)
        sets.append(np.unique(s))
    sets.append(np.unique(np.concatenate([sets[0][5:], rng.integers(-2**63, 2**63, 5)])))
    alike = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if alike(sets[i], sets[j]) >= 0.85}
    assert want == {(0, 80)}
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "row bigint, hashes array<bigint>")
    members = df.select("row", F.lit(0).cast("long").alias("sketch"))
    pre = chosen_path.prefixes(members, df, 85, 100).withColumn("label", F.col("row"))
    got = [(r.u, r.v) for r in chosen_path.prefix_pairs(pre, pre, 85, 100, 64, once=True).collect()]
    assert want <= set(got) and len(got) == len(set(got)) and len(got) < 40


def test_shared_hashes_are_counted_once_not_once_a_task(spark, monkeypatch):
    """Groups of 30 and 90 near copies, dealt over many tasks: the counts have one row a bucket that has hashes."""
    rng = np.random.default_rng(12)
    base, frame, made = rng.integers(-2**63, 2**63, 100), type(spark.range(0)), []
    whole = frame.mapInArrow

    def noted(self, func, schema, *more, **named):
        out = whole(self, func, schema, *more, **named)
        made.append((schema, out))
        return out

    monkeypatch.setattr(frame, "mapInArrow", noted)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")  # tables this small would go to one task
    try:
        for copies in (30, 90):
            sets = [np.unique(np.concatenate([base[9:], rng.integers(-2**63, 2**63, 9)])) for _ in range(copies)]
            rows = [(i, s.tolist()) for i, s in enumerate(sets)]
            df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 30), "row bigint, hashes array<bigint>")
            made.clear()
            chosen_path.prefixes(df.select("row", F.lit(0).cast("long").alias("sketch")), df, 85, 100)
            bucket = np.concatenate(sets).view(np.uint64) % np.uint64(chosen_path.BUCKETS)
            want = dict(zip(*(x.tolist() for x in np.unique(bucket, return_counts=True)), strict=True))
            counts = [x for schema, x in made if schema.startswith("bucket")][0].collect()
            assert len(counts) == len(want) and {r.bucket: r.c for r in counts} == want
    finally:
        spark.conf.set(merge, before)


def test_counts_of_several_tasks_add_up(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "PER_TASK", 50)
    rng = np.random.default_rng(13)
    sets = [np.unique(rng.integers(0, 40, n)) * 7919 for n in rng.integers(1, 30, 60)]
    rows = [(i, s.tolist()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 30), "row bigint, hashes array<bigint>")
    want = np.bincount(np.concatenate(sets) % chosen_path.BUCKETS, minlength=chosen_path.BUCKETS)
    assert (chosen_path.bucket_counts(df) == want).all() and not chosen_path.bucket_counts(df.filter("false")).any()


def test_whole_sets_only_of_rows_that_may_link(spark, monkeypatch):
    """15 near copies at some 0.78 of each other, which their sketches don't tell from links, and two that are links."""
    base, rows = words(150, 21), []
    for i in range(15):
        w = list(base)
        for k in (3, 53, 103):
            w[k + 3 * i] = words(1, 5000 + 1000 * i + k)[0]
        rows.append((i, " ".join(w)))
    rows.append((15, rows[0][1] + " end"))
    want = slow_components(slow_sets(rows, 3), 85, 100)
    assert len(set(want.values())) == 15
    stage, read = chosen_path.stage, []

    def noted(df, name, *more):
        out = stage(df, name, *more)
        if name == "sets":
            read.append(out.count())
        return out

    monkeypatch.setattr(chosen_path, "stage", noted)
    got = {r.doc_id: r.component_id for r in chosen_path.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and read[0] == 2 and sum(read) <= 4


def test_drop_near_keeps_one_of_each(spark, near):
    want = slow_components(slow_sets(near, 5), 80, 100)
    df = clash(spark.createDataFrame(near, "doc_id bigint, text string"))
    kept = chosen_path.drop_near(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_near_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None)], "doc_id bigint, text string")
    got = chosen_path.classes(df).collect()
    assert sum(r.kept for r in got) == 2 and sum(r.component_id == 1 for r in got) == 3
    assert chosen_path.classes(df.filter("false")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_stars_are_settled_at_once(spark, monkeypatch):
    stage, tables = common.stage, []
    monkeypatch.setattr(common, "stage", lambda df, name: (tables.append(name), stage(df, name))[1])
    find = lambda edges: {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    stars = [(0, k) for k in range(1, 60)] + [(100 + k, 100) for k in range(1, 60)] + [(0, 3), (7, 7)]
    assert find(stars) == {k: k - k % 100 for k in (*range(60), *range(100, 160))} and len(tables) == 1
    tables.clear()
    assert find([*stars, (100, 59)]) == dict.fromkeys((*range(60), *range(100, 160)), 0) and len(tables) <= 3
    assert find([(7, 7)]) == {}


def test_components_go_on_from_earlier_ones(spark, monkeypatch):
    pairs = lambda rows: spark.createDataFrame(rows, "u bigint, v bigint")
    root = chosen_path.widened(None, pairs([(2, 1), (2, 3), (3, 9), (5, 6), (6, 7)]))
    stage, tables = common.stage, []
    monkeypatch.setattr(common, "stage", lambda df, name: (tables.append(name), stage(df, name))[1])
    assert chosen_path.widened(root, pairs([])) is root and not tables
    got = {r.node: r.root for r in chosen_path.widened(root, pairs([(7, 9), (20, 21)])).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 5, 6, 7, 9), 1), 20: 20, 21: 20} and len(tables) <= 4


def test_links_join_components_by_their_smallest_rows_alone(spark, monkeypatch):
    """Two components of 60 rows and a link between two of their rows: one edge goes on, not 119."""
    pairs = lambda rows: spark.createDataFrame(rows, "u bigint, v bigint")
    root = chosen_path.widened(None, pairs([(b, b + k) for b in (0, 100) for k in range(1, 60)]))
    parts, edges = chosen_path.components, []
    monkeypatch.setattr(chosen_path, "components", lambda found: (edges.append(found.count()), parts(found))[1])
    got = [(r.node, r.root) for r in chosen_path.widened(root, pairs([(59, 130), (7, 300)])).collect()]
    assert edges == [2] and sorted(got) == [(k, 0) for k in (*range(60), *range(100, 160), 300)]


def test_linked_stars_settle_in_one_round(spark, monkeypatch):
    stage, tables = common.stage, []
    monkeypatch.setattr(common, "stage", lambda df, name: (tables.append(name), stage(df, name))[1])
    edges = [(b, b + k) for b in (0, 100) for k in range(1, 60)] + [(100, 59)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {b + k: 0 for b in (0, 100) for k in range(60)} and tables.count("edges") == 1


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_without_broadcasts_are_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MAX_BROADCAST", most)
    rng = np.random.default_rng(5)
    groups = [rng.permutation(np.arange(b, b + 40)).tolist() for b in (0, 40, 80)]
    edges = [p for g in groups for p in itertools.pairwise(g)] * 2 + [(0, 0), (500, 501), (500, 502)]
    frame = lambda rows: spark.createDataFrame(rows, "u bigint, v bigint")
    want = {**{k: k - k % 40 for k in range(120)}, 500: 500, 501: 500, 502: 500}
    root = common.components(frame(edges))
    assert sorted((r.node, r.root) for r in root.collect()) == sorted(want.items())
    want |= {**dict.fromkeys(range(80, 120), 40), 500: 0, 501: 0, 502: 0, 600: 0}
    got = chosen_path.widened(root, frame([(600, 501), (500, 3), (3, 502), (45, 119)]))
    assert sorted((r.node, r.root) for r in got.collect()) == sorted(want.items())


def test_near_components_without_broadcasts(spark, near, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 8)
    monkeypatch.setattr(common, "MAX_BROADCAST", 0)
    got = {r.doc_id: r.component_id for r in chosen_path.classes(spark.createDataFrame(near, "doc_id bigint, text string")).collect()}
    assert got == slow_components(slow_sets(near, 3), 85, 100)


# --- 9 ---------------------------------------------------------------------------------------

def slow_targets(sizes, weights, share, most):
    total, capped = share * sum(sizes), set()
    while True:
        rest = [k for k in range(len(sizes)) if k not in capped]
        level = (total - sum(most * sizes[k] for k in capped)) / sum(weights[k] for k in rest) if rest else 0
        over = {k for k in rest if weights[k] * level > most * sizes[k]}
        if not over:
            return [most * s if k in capped else weights[k] * level for k, s in enumerate(sizes)]
        capped |= over


def mix_rows(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 80))), "en", str(rng.choice(["b", "a", "Z", "é", "hot", None], p=[.1, .1, .05, .05, .6, .1]))) for k in range(900)]
    return [(i, t, la, None if s == "None" else s) for i, t, la, s in rows] + [(900, None, None, "a"), (901, "", "en", "none"), (902, "\t", "en", "")]


def test_mix_targets_and_takes(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "ROWS_PER_BUCKET", 50)  # several buckets a source
    rows = mix_rows()
    df = clash(spark.createDataFrame(rows, DOC)).repartition(4)
    docs, takes, sources = curriculum.mix(df)
    names = sorted({s for *_, s in rows if s is not None}, key=lambda s: s.encode()) + [None]
    size = {s: sum(len((t or "").split()) for _, t, _, x in rows if x == s) for s in names}
    want = dict(zip(names, slow_targets([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2), strict=True))
    got = {(None if r.source_key.none else r.source_key.name): r for r in sources.collect()}
    assert set(got) == set(want)
    for s in names:
        assert got[s].target == pytest.approx(want[s]) and got[s].source_size == size[s]
    taken = {}
    by_row = {r.row: r for r in docs.collect()}
    for r in takes.collect():
        taken.setdefault(r.row, []).append(r)
        assert 0 <= r.position <= 1 and r.words == by_row[r.row].size
    for s in names:
        mine = sum(x.words for r, xs in taken.items() for x in xs if (None if by_row[r].source_key.none else by_row[r].source_key.name) == s)
        assert abs(mine - want[s]) <= 80
    assert all(len(x) <= 2 for x in taken.values())
    again = {(r.row, r.copy, r.position) for r in curriculum.mix(df.repartition(7))[1].collect()}
    assert again == {(r.row, r.copy, r.position) for xs in taken.values() for r in xs}


def test_schedule_moves_positions(spark):
    rows = [(k, "w " * 10, "en", "ab"[k % 2]) for k in range(400)]
    plan = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 0.0), ("b", 0.0, 0.0), ("b", 1.0, 1.0)], "source string, t double, w double")
    docs, takes, _ = curriculum.mix(spark.createDataFrame(rows, DOC), weights=(1,), share=1.0, schedule=plan)
    got = takes.join(docs, "row").groupBy("source_key.name").agg(F.avg("position").alias("p"), F.sum(F.when(F.col("position") < 0.5, 1).otherwise(0)).alias("early")).collect()
    p = {r.name: r for r in got}
    # demand of a falls in proportion to time, so three quarters of it come in the first half
    assert p["a"].p == pytest.approx(1 / 3, abs=0.01) and p["b"].p == pytest.approx(2 / 3, abs=0.01)
    assert abs(p["a"].early - 150) <= 2 and abs(p["b"].early - 50) <= 2


def test_mix_is_native_and_ordered(spark):
    df = spark.createDataFrame(mix_rows(1), DOC)
    out = curriculum.mixed_rows(df)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert out.columns == df.columns and out.count() > 900
    empty = curriculum.mix(df.filter("false"))
    assert [x.count() for x in empty] == [0, 0, 0]
    nothing = curriculum.mix(df.filter("text is null"))
    assert [x.count() for x in nothing] == [1, 0, 1]


# --- 10 --------------------------------------------------------------------------------------

def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = docs.filter("doc_id % 2 = 0").select("text", F.col("lang").alias("label"))
    rest = docs.filter("doc_id % 2 = 1")
    # no declared language: the text and the source alone decide
    got = language_fusion.identify(rest.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("host")), labelled=known)
    r = got.join(rest, got.id == rest.doc_id).agg(F.avg((F.col("language") == F.col("lang")).cast("int")).alias("right"), F.avg(F.col("accepted").cast("int")).alias("ok")).first()
    assert r.right >= 0.97 and r.ok == 1.0


def brute_posteriors(scored, languages, weight):
    """Evidence fusion row by row, from the text posteriors."""
    told = [r for r in scored if r["n"] > 0]
    size = len(languages)
    sums = lambda key: {k: np.sum([r["p"] for r in told if r[key] == k], axis=0) for k in {r[key] for r in told}}
    world = np.sum([r["p"] for r in told], axis=0) + 1
    world = world / world.sum()
    out = {}
    for r in scored:
        own = np.array(r["p"]) if r["n"] else np.zeros(size)
        logs = np.array(r["ll"]) if r["n"] else np.zeros(size)
        for key in ("declared", "suffix"):
            if r[key] is not None:
                table = {k: v for k, v in sums(key).items() if k is not None}
                if r[key] in table:
                    total = np.sum(list(table.values()), axis=0)
                    logs = logs + np.log((table[r[key]] + 1) / (total + len(table) + 1))
        host, parent = {}, {}
        for x in told:
            host[(x["parent"], x["host"])] = host.get((x["parent"], x["host"]), 0) + np.array(x["p"])
            parent[x["parent"]] = parent.get(x["parent"], 0) + np.array(x["p"])
        prior = world
        if r["host"] is not None and (r["parent"], r["host"]) in host:
            for s in ([parent[r["parent"]]] if r["parent"] is not None else []) + [host[(r["parent"], r["host"])]]:
                left = np.maximum(s - own, 0)
                prior = (left + weight * prior) / (left.sum() + weight)
        logs = logs + np.log(prior)
        e = np.exp(logs - logs.max())
        out[r["id"]] = e / e.sum()
    return out


def test_fusion_equals_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(60).collect()]
    rows = [(r.doc_id, (r.text or "")[: 12 if k % 3 else 400], [r.lang, None, "de"][k % 3], [".fr", ".com", None][k % 3], [f"h{k % 5}", None][k % 7 == 0], [f"d{k % 2}", None][k % 4 == 0])
            for k, r in enumerate(docs)]
    rows += [(-1, None, "en", ".com", "h1", "d1"), (-2, "12345 !!", None, None, None, None), (-3, "12345 !!", "xx", ".zz", "new", "new")]
    df = clash(spark.createDataFrame(rows, "id bigint, text string, declared string, suffix string, host string, parent string"))
    known = spark.createDataFrame([(r.text, r.lang) for r in docs], "text string, label string")
    langs = sorted({r.lang for r in docs})
    model = language_fusion.train(known, langs)
    scored = language_fusion.score(df.select("id", "text", "declared", "suffix", "host", "parent"), model).withColumn("p", language_fusion.softmax(F.col("loglik"))).collect()
    scored = [{**r.asDict(), "n": r.n_grams, "ll": r.loglik} for r in scored]
    want = brute_posteriors(scored, langs, language_fusion.HOST_WEIGHT)
    got = {r.id: r for r in language_fusion.identify(df, labelled=known).collect()}
    assert set(got) == set(want)
    for i, p in want.items():
        if i != -3:  # unseen values: counted as their own kind only if some row with text has them
            assert got[i].posteriors == pytest.approx(p.tolist(), abs=1e-9)
            assert got[i].language == langs[int(np.argmax(p))]
    assert not got[-1].accepted and not got[-2].accepted and got[-2].text_language is None


def test_language_odd_tables(spark):
    df = spark.createDataFrame([(1, "hello", None), (1, "hello", None), (None, None, None)], "id bigint, text string, declared string")
    got = language_fusion.identify(df).collect()
    assert len(got) == 3 and not any(r.accepted for r in got) and {r.language for r in got} == {None}
    assert language_fusion.identify(df.filter("false")).count() == 0


def test_every_declared_language_is_a_class(spark):
    """More languages than 64, some with a handful of rows, beside one with many."""
    rows, i = [], 0
    for l in range(70):
        own = words(12, 1000 + l)
        for k in range(30 if l == 0 else 2 + l % 4):
            rows.append((i, " ".join(own[(k + j) % 12] for j in range(10)), f"l{l:02d}", None))
            i += 1
    df = spark.createDataFrame(rows, "id bigint, text string, declared string, host string")
    got = {r.id: r for r in language_fusion.identify(df).collect()}
    assert len(got) == len(rows) and all(got[r[0]].language == r[2] and len(got[r[0]].posteriors) == 70 for r in rows)


def test_every_suffix_has_its_own_counts(spark):
    a, b = " ".join(words(40, 1)), " ".join("xyzw" + w for w in words(40, 2))
    rows = [(2 * k + j, a, "aa", f"s{k:04d}") for k in range(1100) for j in (0, 1)] + [(5000, b, "bb", "rare"), (5001, None, None, "rare")]
    df = spark.createDataFrame(rows, "id bigint, text string, declared string, suffix string")
    got = language_fusion.identify(df).filter("id = 5001").first()
    of = {"aa": (2200 + 1) * 1 / (2200 + 1101 + 1), "bb": (1 + 1) * 2 / (1 + 1101 + 1)}  # share of all told rows x share of the suffix
    assert got.posteriors == pytest.approx([of["aa"] / sum(of.values()), of["bb"] / sum(of.values())], abs=1e-6)


def test_language_stage_without_declared_languages(spark):
    df = spark.createDataFrame([(1, "hello there", None, "a"), (2, "123", None, "a"), (3, None, None, None), (4, "\u0434\u0430", None, "b")], DOC)
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, df, SF)
    assert {r.doc_id for r in kept.collect()} == {1, 4}


# --- 5 ---------------------------------------------------------------------------------------

def slow_host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host):])[0]


def slow_rule(host, path):
    best = None
    for rule, verdict in url_words.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(rule), rule) > (len(best[0]), best[0])):
            best = (rule, verdict)
    return best


def test_urls(spark):
    urls = ["https://WWW.Example.org/es/a?x#y", "http://example.org/en/12", "http://notexample.org/en/1", "x.com/fr/", "ftp://com/fr/1", "http://a.com/de/", "http://a.com", "http://org",
            "http://org/", "http://cheappills.example.net/en/5", "http://therecasino.example.net/", "http://there.example.net/en/5", None, "", "://", "a://b://c/d", "http://É.com/fr/#", "http://h.com?q=/fr/",
            "http://" + "z" * 90 + ".net/x", "http://ends.org\n/x"]
    urls += ["http://there.example.net/en/5"] * 30 + [f"http://spam.example.net/{k}" for k in range(5)]
    rows = [(k, u, "<p>there is a casino and pills are cheap there</p>") for k, u in enumerate(urls)]
    df = clash(spark.createDataFrame(rows, "id bigint, url string, text string"))
    got = {r.id: r for r in url_words.judge(df).collect()}
    assert len(got) == len(rows)
    for k, u, _ in rows:
        host, path = slow_host_path(u)
        rule = slow_rule(host, path)
        assert (got[k].host, got[k].path) == (host, path), u
        assert got[k].rule == (rule and rule[0]) and got[k].verdict in ("allow", "block")
        if rule:
            assert got[k].verdict == rule[1]
    assert got[9].host_words[:2] == ["cheap", "pills"] and got[9].verdict == "block" == got[10].verdict and got[11].verdict == "allow"
    assert url_words.judge(df.filter("false")).count() == 0


def test_long_words_are_known(spark):
    """A word of any length that the pages hold is split off."""
    long = "incomprehensibilitiesabroad"
    rows = [(i, f"http://{long}cheap.net/", f"<p>{long} and cheap things</p>") for i in range(30)]
    got = url_words.judge(spark.createDataFrame(rows, "id bigint, url string, text string")).first()
    assert len(long) > 24 and got.host_words[:2] == [long, "cheap"]


def test_many_languages_in_one_plan(spark):
    """300 declared values, most of them on one row alone: one result a row, posteriors over all of them."""
    rows = [(i, f"plain words of text {i % 7}", f"l{i:03d}" if i < 300 else "en", None, f"h{i % 5}.net", "net") for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, text string, declared string, suffix string, host string, parent string")
    got = language_fusion.identify(df).select("id", "language", "posterior", F.size("posteriors").alias("k"),
                                              F.aggregate("posteriors", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert len(got) == 400 and all(r.k == 301 and abs(r.s - 1) < 1e-9 and r.language for r in got)


def test_best_split_equals_all_splits():
    words_n = {"the": 50, "there": 20, "re": 5, "cas": 1, "casino": 9, "in": 30, "o": 3}

    def splits(s):
        if not s:
            yield []
        for k in range(1, len(s) + 1):
            for rest in splits(s[k:]):
                yield [s[:k], *rest]

    value = lambda parts: sum(np.log(words_n[p] / 200) if p in words_n else -np.log(200) - len(p) * np.log(10) for p in parts)
    for name in ("therecasino", "thein", "xyz", "casinox", "inthere", ""):
        got = url_words.best_split(name, words_n, 200)
        assert "".join(got) == name and value(got) == pytest.approx(max(map(value, splits(name))))


def test_labelled_urls_train_the_model(spark):
    known = spark.createDataFrame([(f"http://good{k}.net/ok", "allow") for k in range(20)] + [(f"http://x{k}.net/evil/page", "block") for k in range(20)], "url string, label string")
    df = spark.createDataFrame([(1, "http://new.net/evil/page", None), (2, "http://new.net/ok", None)], "id bigint, url string, text string")
    assert {r.id: r.verdict for r in url_words.judge(df, rules=(), labelled=known).collect()} == {1: "block", 2: "allow"}


# --- pipeline --------------------------------------------------------------------------------

def pipeline_docs(spark, near):
    rows = [(i, t, "en", "hot" if i % 3 else "s") for i, t in near] + [(9000 + i, t, "en", "copy") for i, t in near[:40]] + [(9500, "123 !!!", "en", "s"), (9501, None, None, None)]
    return spark.createDataFrame(rows, DOC).withColumn("n_chars", F.length("text"))


def test_stages(spark, near, tmp_path):
    docs = pipeline_docs(spark, near)
    by_name = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    told = [(i, t) for i, t in rows if re.search("[A-Za-z]", t or "")]
    a = by_name["language_id"](spark, docs, SF)
    assert {r.doc_id for r in a.collect()} == {i for i, _ in told}
    b = by_name["exact_dedup"](spark, a, SF)
    first = {}
    for i, t in sorted(told):
        first.setdefault(re.sub("[\x20\x09-\x0D]+", " ", t), i)
    assert {r.doc_id for r in b.collect()} == set(first.values())
    c = by_name["near_dedup"](spark, b, SF)
    left = [(i, t) for i, t in told if i in set(first.values())]
    assert {r.doc_id for r in c.collect()} == set(slow_components(slow_sets(left, 5), 80, 100).values())
    d = by_name["mixing"](spark, c, SF)
    assert a.columns == b.columns == c.columns == d.columns == docs.columns
    e = by_name["sentencepiece"](spark, d, SF).collect()
    import hashlib

    text = dict(rows)
    assert len(e) == d.count() and all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in e)
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


# --- row keys, default schedule ----------------------------------------------------------------

def test_row_keys_of_any_type(spark):
    for ids, kind in ((["b", "a", "10", "9"], "string"), ([1.2, 1.7, -3.0, 2.0], "double"), ([3, 1, 2, 0], "int")):
        df = spark.createDataFrame([(i, f"text {i}") for i in ids], f"doc_id {kind}, text string").repartition(3)
        got = sorted((r.row, r.doc_id) for r in common.with_row_key(df, "row").collect())
        assert [i for _, i in got] == sorted(ids) and len({r for r, _ in got}) == 4
        kept = radix_dedup.drop_copies(df.unionAll(df))
        assert sorted(r.doc_id for r in kept.collect()) == sorted(ids)


def test_default_shapes_order_the_sources(spark):
    rows = [(k, "w " * 10, "en", "abc"[k % 3]) for k in range(900)]
    docs, takes, _ = curriculum.mix(spark.createDataFrame(rows, DOC), weights=(1,), share=1.0)
    got = takes.join(docs, "row").groupBy("source_key.name").agg(F.avg("position").alias("p"), F.stddev_pop("position").alias("s"), F.count("*").alias("n")).collect()
    p = {r.name: r for r in got}
    # means and spread of densities 1.5 - t, 0.5 + 2 t up to the middle and back, 0.5 + t
    assert p["a"].p == pytest.approx(0.75 - 1 / 3, abs=0.01) and p["b"].p == pytest.approx(0.5, abs=0.01) and p["c"].p == pytest.approx(0.25 + 1 / 3, abs=0.01)
    assert p["b"].s == pytest.approx((1 / 16) ** 0.5, abs=0.02) and {r.n for r in got} == {300}
