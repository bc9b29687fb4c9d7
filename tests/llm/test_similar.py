"""Near-duplicates, leaks and neighbours against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import leaks, neardup, neighbours

WORD = re.compile(r"[^\W_]+")
rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]


def sample_text(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def records():
    out = []
    for k in range(120):
        w = sample_text(rng.randint(15, 90))
        out.append(("block", f"b{k}", " ".join(w)))
        for c in range(rng.choice([0, 0, 1, 3])):
            v = list(w)
            for _ in range(rng.randint(0, 6)):
                v[rng.randrange(len(v))] = rng.choice(VOCABULARY)
            out.append((rng.choice(["block", "chunk"]), f"b{k}v{c}", ", ".join(v).upper()))
    out += [("block", f"copy{n}", out[5][2]) for n in range(6)]
    return [*out, ("block", "null", None), ("block", None, "x " * 30), ("block", "empty", ""), ("block", "same", "word " * 40)]


def brute_pairs(rows, similarity, k):
    sets = {}
    for kind, i, t in rows:
        w = WORD.findall((t or "").lower())
        if i is not None and len(w) >= 20:
            sets[kind, i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    out = set()
    for (ka, a), sa in sets.items():
        for (kb, b), sb in sets.items():
            if ka == kb and a < b and len(sa & sb) >= similarity * len(sa | sb):
                out.add((ka, a, b))
    return out


def test_similar_pairs(spark):
    rows = records()
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    df = df.union(df.limit(30)).withColumn("rep", F.lit(1))
    for similarity, k in ((0.6, 3), (0.8, 5)):
        truth = brute_pairs(rows, similarity, k)
        got = {(r.rec_kind, r.id_a, r.id_b) for r in neardup.similar_pairs(df, similarity=similarity, k=k).collect()}
        assert got <= truth and len(got) >= 0.98 * len(truth) and len(truth) > 20
    crowded = {(r.rec_kind, r.id_a, r.id_b) for r in neardup.similar_pairs(df, similarity=0.6, k=3, most_in_block=1).collect()}
    assert crowded == brute_pairs(rows, 0.6, 3)  # all blocks are crowded: the exact way finds every pair
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def test_groups(spark):
    rows = records()
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    pairs = brute_pairs(rows, 0.8, 5)
    got = {(r.kind, r.id): r for r in neardup.groups(df).collect()}
    parent = {k: k for k in got}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for kind, a, b in pairs:
        parent[find((kind, a))] = find((kind, b))
    members = {}
    for k in got:
        members.setdefault(find(k), []).append(k[1])
    links = {k: sum(k in ((p[0], p[1]), (p[0], p[2])) for p in pairs) for k in got}
    wrong = [k for k in got if got[k].group_id != min(members[find(k)]) or got[k].n_links != links[k]]
    assert len(wrong) <= 2
    assert "null" not in {k[1] for k in got}


def test_groups_of_short_texts(spark):
    """Texts too short for a shingle, or for p6_found, have rows and groups too."""
    rows = [("block", "a", "Total amount"), ("block", "b", "total, AMOUNT!"), ("block", "c", "amount total"), ("chunk", "d", "Total amount"), ("block", "e", "-"), ("block", "f", "-"), ("block", "g", "+")]
    rows += [("block", "n", None), ("block", "o", None), ("block", "p", ""), ("block", None, "x"), ("block", "q", "one two three four five six"), ("block", "r", "One two three four five six."), ("block", "s", "one two three four five")]
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    got = {r.id: (r.group_id, r.n_links) for r in neardup.groups(df.union(df.limit(4)), every=True).collect()}
    alone = {i: (i, 0) for i in "cdgnops"}
    assert got == alone | {"a": ("a", 1), "b": ("a", 1), "e": ("e", 1), "f": ("e", 1), "q": ("q", 1), "r": ("q", 1)}


def test_components(spark):
    edges = [(n, n + 1) for n in range(60)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[n] == 0 for n in range(61)) and {got[n] for n in (100, 101, 102)} == {100}


def brute_leaks(docs, items, run=12):
    grams = {}
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for j in range(len(w) - run + 1):
            grams.setdefault(tuple(w[j : j + run]), set()).add(i)
    return {(d, i) for d, t in docs for w in [WORD.findall((t or "").lower())] for j in range(len(w) - run + 1) for i in grams.get(tuple(w[j : j + run]), ())}


def test_leaks(spark):
    items = [(i, " ".join(sample_text(rng.randint(8, 40)))) for i in range(30)] + [(90, None), (91, "")]
    items.append((50, items[20][1] + " tail words here"))
    docs = []
    for d in range(200):
        w = sample_text(60)
        source = rng.choice(items[:30])[1].split()
        a, n = rng.randrange(max(1, len(source) - 5)), rng.choice([5, 11, 12, 13, 40])
        if d % 2:
            at = rng.randrange(50)
            w[at:at] = [x.upper() for x in source[a : a + n]]
        docs.append((d, ", ".join(w)))
    docs += [(1000, None), (1001, ""), (1002, " ".join(["same"] * 50))]
    dd = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    ii = spark.createDataFrame(items, "item_id bigint, text string").withColumn("h", F.lit(1))
    truth = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(dd.union(dd.limit(3)), ii.union(ii.limit(3))).collect()}
    assert got == truth and len(truth) > 10
    keep, leaks.MOST_BROADCAST = leaks.MOST_BROADCAST, 0
    try:
        assert {(r.doc_id, r.item_id) for r in leaks.leaks(dd, ii).collect()} == truth  # the way for many items
    finally:
        leaks.MOST_BROADCAST = keep
    assert leaks.leaks(dd.limit(0), ii).count() == 0 and leaks.leaks(dd, ii.limit(0)).count() == 0


def vectors():
    g = np.random.default_rng(2)
    centres = g.normal(size=(150, 64))
    x = np.vstack([c + 0.12 * np.linalg.norm(c) / 8 * g.normal(size=(g.integers(1, 25), 64)) * g.uniform(0.3, 4) for c in centres])
    return x.astype(np.float32)


def truth_of(x, k, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(min(r, c), max(r, c)) for r in range(len(x)) for c in top[r].tolist() if s[r, c] >= least}


def test_neighbours(spark):
    x = vectors()
    name = "v{:05d}".format
    rows = [(name(n), v.tolist()) for n, v in enumerate(x)]
    odd = [(None, rows[0][1]), ("null", None), ("empty", []), ("short", [1.0] * 32), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] * 64)]
    df = spark.createDataFrame(rows + odd + rows[:20], "id string, v array<float>").withColumn("vid", F.lit(1))
    truth = {(name(a), name(b)) for a, b in truth_of(x, 10, 0.85)}
    got = {(r.chunk_id_a, r.chunk_id_b) for r in neighbours.found_pairs(df, candidates=300).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.02 * len(got)
    near = {}
    for r in neighbours.most_similar(df, candidates=600).collect():
        near.setdefault(r.id, set()).add(r.other)
    full = {name(r): set() for r in range(len(x))}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for r in range(len(x)):
        full[name(r)] = {name(c) for c in np.argsort(-s[r])[:10]}
    assert set(near) == set(full) and all(len(v) == 10 for v in near.values())
    assert sum(len(near[k] & full[k]) for k in full) >= 0.9 * 10 * len(full)
    assert neighbours.most_similar(df.limit(0)).count() == 0


def test_neighbours_of_copies_and_few(spark):
    one = [1.0] + [0.0] * 63
    df = spark.createDataFrame([(f"c{n:02d}", one) for n in range(30)] + [("other", [0.9, 0.1] + [0.0] * 62)], "id string, v array<float>")
    got = {}
    for r in neighbours.most_similar(df).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    assert got["c05"] == [f"c{n:02d}" for n in range(11) if n != 5] and len(got["other"]) == 10
    assert neighbours.most_similar(df.limit(1)).count() == 0


def test_neighbours_hold_recall(spark):
    """Few candidates are raised until far neighbours are found too."""
    x = np.random.default_rng(4).normal(size=(1500, 64)).astype(np.float32)
    df = spark.createDataFrame([(f"{n}", v.tolist()) for n, v in enumerate(x)], "id string, v array<float>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    truth = {(str(r), str(c)) for r in range(len(x)) for c in np.argsort(-s[r])[:10]}
    got = {(r.id, r.other) for r in neighbours.most_similar(df, candidates=50, recall=0.93).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got) == len(truth)


def test_wide_visits_hold_the_narrow_ones():
    """Cells taken up to a distance are those from the heap and at most a step more; both code the same cells."""
    g = np.random.default_rng(8)
    ix = neighbours.Index.__new__(neighbours.Index)
    ix.n, ix.counts = 10**9, g.integers(0, 5, (9, 7))
    ix.groups = [np.array([0, 1, 0, 2, 1, 0, 2, 2, 1]), np.array([0, 1, 1, 0, 0, 1, 1])]
    ix.members = [[np.flatnonzero(x == a) for a in range(x.max() + 1)] for x in ix.groups]
    ix.place = [np.array([int((x[:c] == x[c]).sum()) for c in range(len(x))]) for x in ix.groups]
    d1, d2 = g.random((20, 9)), g.random((20, 7))
    for candidates in (1, 20, 1000):
        ix.n = 10**9
        narrow = [{(a, n) for a, code in at for n in np.frombuffer(code, np.uint16).tolist()} for at in ix.visits(d1, d2, candidates)]
        ix.n = 1
        wide = [{(a, n) for a, code in at for n in np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8))).tolist()} for at in ix.visits(d1, d2, candidates)]
        assert all(a <= b and len(b) <= len(a) + 3 for a, b in zip(narrow, wide, strict=True))
