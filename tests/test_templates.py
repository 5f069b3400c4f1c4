"""Template mining doesn't depend on order, partitions or group sizes."""

from collections import Counter

from logsift.operators.templates import template_table


def lines(n):
    words = ["alpha", "beta", "gamma", "delta"]
    out = [(f"open file {w} for user {u}" if i % 3 else f"open file {w} by root")
           for i in range(n) for w, u in [(words[i * 7 % 4], f"u{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}")]]
    return out + ["single", "open port 80", "open port 81 now"]


def brute(texts, threshold=0.4):
    toks = [["<*>" if any(c.isdigit() for c in t) else t for t in x.split()] for x in texts]
    leaf = [(len(t), tuple(t[:2])) for t in toks]
    size, count = Counter(leaf), Counter((l, k, t) for l, ts in zip(leaf, toks) for k, t in enumerate(ts))
    return [" ".join(t if count[(l, k, t)] >= threshold * size[l] else "<*>" for k, t in enumerate(ts)) for l, ts in zip(leaf, toks)]


def test_equals_brute_force_for_any_size_and_partitioning(spark):
    for n in (40, 400, 1500):
        texts = lines(n)
        want = Counter(brute(texts))
        for parts in (1, 3, 8):
            df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no bigint, message string").repartition(parts)
            table = template_table(df).collect()
            got = Counter()
            for r in table:
                got[r["template_str"]] += r["lines"]
            assert got == want
            first = {t: i for i, t in reversed(list(enumerate(brute(texts))))}
            rank = {t: k + 1 for k, t in enumerate(sorted(first, key=first.get))}
            assert all(r["template_id"] == rank[r["template_str"]] for r in table)


def test_rare_kinds_beside_a_hot_one_keep_their_words(spark):
    kinds = (["Exception in receiveBlock for block x from peer"] * 900 + ["Exception in writeBlock while closing its output stream"] * 50
             + ["Exception in diskCheck because volume has gone readonly"] * 50)
    equal = [f"a b {k}c {k}d {k}e {k}f" for k in "xyz" for _ in range(20)]
    users = [f"open door u{chr(97 + i % 26)}{chr(97 + i // 26)} by clerk w{chr(97 + i % 26)}" for i in range(300)]  # many patterns, one kind
    masked = ["<*> 1 2 3", "<*> 4 5 6 7"]  # no fixed token at all
    texts = kinds + equal + users + masked
    want = {k: texts.count(k) for k in kinds + equal} | {"open door <*> by clerk <*>": 300, "<*> <*> <*> <*>": 1, "<*> <*> <*> <*> <*>": 1}
    for parts in (1, 5):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no bigint, message string").repartition(parts)
        got = template_table(df).groupBy("template_str").agg({"lines": "sum"}).collect()
        assert {r[0]: r[1] for r in got} == want


def test_many_unlike_kinds_take_one_round(spark, monkeypatch):
    """20,000 kinds in one leaf, three patterns each: leaders in one round, their followers in the same."""
    import logsift.operators.templates as M
    written = []
    kept = M.staged
    monkeypatch.setattr(M, "staged", lambda df, name: (written.append(name), kept(df, name))[1])
    name = lambda col: f"translate(cast({col} as string), '0123456789', 'abcdefghij')"
    kind, one = name("id div 3"), name("id % 3")
    df = spark.range(60000).selectExpr("id AS line_no", f"concat_ws(' ', 'a', 'b', concat('k', {kind}), concat('q', {kind}), concat('r', {kind}), "
                                       f"concat('v', {one}, {kind}), concat('w', {kind})) AS message")
    got = template_table(df).groupBy("template_str").agg({"lines": "sum"}).collect()
    assert len(got) == 20000 and all(r[1] == 3 and r[0].split()[5] == "<*>" and r[0].count("<*>") == 1 for r in got)
    assert written.count("clusters") == 1


def test_clusters_by_brute_force(spark):
    """Leaders are unlike each other, and every follower is like its leader."""
    import random

    from logsift.operators.templates import _clustered
    rnd = random.Random(3)
    pats = {tuple(["a", "b"] + [rnd.choice(["<*>", "c", "d", "e", "f", "g" + str(k)]) for k in range(4)]) for _ in range(400)}
    rows = [("leaf", " ".join(p), list(p), rnd.randrange(1, 9)) for p in pats]
    df = spark.createDataFrame(rows, "leaf string, pattern string, tokens array<string>, n bigint")
    like = lambda x, y: sum(a == b != "<*>" for a, b in zip(x.split(), y.split())) / 6 >= 0.5
    one = {r.pattern: r.cluster for r in _clustered(df, 0.5).collect()}
    assert one.keys() == {" ".join(p) for p in pats} and one == {r.pattern: r.cluster for r in _clustered(df.repartition(7), 0.5).collect()}
    leaders = {p for p, c in one.items() if p == c}
    assert set(one.values()) == leaders and 3 < len(leaders) < len(pats)
    assert all(like(p, c) for p, c in one.items() if p != c)
    assert not any(like(x, y) for x in leaders for y in leaders if x < y)
