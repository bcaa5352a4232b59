import random
from collections import defaultdict
from math import comb

import numpy as np
import pyarrow as pa

from tessella.llm import minhash_dedup as M
from tessella.llm.text import Words, segment_starts

from .conftest import prose


def brute(rows, threshold=M.THRESHOLD):
    """Groups by comparing every pair of shingle sets."""
    sets = {}
    for i, t in rows:
        if i is not None and t:
            words = t.lower().split()
            if words:
                sets[i] = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for i in ids:
        groups[find(i)].add(i)
    return {i: g for g, members in groups.items() if len(members) > 1 for i in members}


def edited(text, rate, r):
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < rate else w for w in text.split())


def test_groups_match_brute_force(spark):
    r = random.Random(9)
    rows = []
    for g in range(12):
        base = prose(r.choice([8, 40, 150]), 100 + g)
        rows += [(len(rows), base)]
        for _ in range(r.choice([0, 1, 3, 12])):
            rows.append((len(rows), edited(base, r.choice([0, 0.02, 0.05, 0.5]), r)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x.group_id for x in M.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_looks_follow_the_posterior():
    # least_matches is the posterior's tail: checked against the sum of the binomial's terms
    for n, m in M.least_matches(0.6, 0.005):
        tail = lambda k: sum(comb(n + 1, j) * 0.6**j * 0.4 ** (n + 1 - j) for j in range(k + 1))  # noqa: B023, E731
        assert tail(m) >= 0.005 and (m == 0 or tail(m - 1) < 0.005)


def boilerplate(n, r):
    """Documents that share half of their words and are otherwise unlike, some with a near copy."""
    shared = prose(60, 77)
    rows = [shared + " " + prose(60, 1000 + k, 10**6) for k in range(n)]
    return rows + [edited(t, 0.03, r) for t in rows[: n // 20]]


def test_a_pivot_unlike_the_others_does_not_hide_them(spark):
    # all are in one bucket with the first one, and only near-copies of each other
    r = random.Random(6)
    rows = list(enumerate(boilerplate(60, r)))
    want = brute(rows)
    compared = []
    for exact in (10**6, 4):  # all pairs of a bucket, or buckets divided further
        got = {x.doc_id: x.group_id for x in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), exact=exact, compared=compared).collect()}
        assert want and got == want


def test_pairs_grow_with_rows_where_many_share_boilerplate(spark):
    sizes = []
    for n in (500, 2000):
        rows, compared = list(enumerate(boilerplate(n, random.Random(n)))), []
        got = {x.doc_id: x.group_id for x in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), exact=16, compared=compared).collect()}
        copies = {n + k: k for k in range(n // 20)}
        assert sum(got.get(c) == k for c, k in copies.items()) >= 0.95 * len(copies) and len(got) <= 2 * len(copies)
        sizes.append(sum(compared))
    assert sizes[1] < 6 * sizes[0]  # 16 times as many pairs in all


def test_large_buckets_lose_no_link(spark):
    # pairs just above the threshold that agree in one band, in a bucket of many documents which are unlike them
    r = random.Random(12)
    base = boilerplate(2000, r)[:2000]
    sides = [base, [edited(t, 0.085, r) for t in base]]
    a, b = (pa.array(x, pa.large_string()) for x in sides)
    bands = []
    for x in (a, b):
        s, t = Words(x).shingles(M.SHINGLE)
        bands.append(M.signatures(s, segment_starts(t, len(x))).reshape(len(x), M.BANDS, -1))
    agree = (bands[0] == bands[1]).all(axis=2)
    others = np.array([max((bands[0][:100, k] == bands[0][i, k]).all(axis=1).sum() for k in np.flatnonzero(agree[i])) if agree[i].any() else 0 for i in range(len(base))])
    some = np.flatnonzero((agree.sum(axis=1) == 1) & (M.jaccard(a, b) >= M.THRESHOLD) & (others > 0) & (np.arange(len(base)) >= 100))
    assert len(some)
    rows = list(enumerate(base[:100] + [side[i] for i in some for side in sides]))
    got = {x.doc_id: x.group_id for x in M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), exact=2).collect()}
    assert got == brute(rows) and len(got) == 2 * len(some)


def test_repeated_ids_are_one_document(spark):
    a, b, c = (prose(80, k) for k in (1, 2, 3))
    w = Words(pa.array([a, b], pa.large_string()))
    first = min(range(2), key=lambda k: tuple(int(p[k]) for p in M.prints(w)))
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "z"), (2, a, "x"), (3, b, "x"), (4, c, "x"), (4, None, "y"), (5, c + " tail", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, loser string").withColumn("__loser", M.F.lit(1)).withColumn("P1", M.F.lit(2)).withColumn("place", M.F.lit(3)).withColumn("n", M.F.lit(4))
    want = {1: 1, 2 + first: 1, 4: 4, 5: 4}
    for _ in range(2):
        docs = docs.repartition(3)
        assert {x.doc_id: x.group_id for x in M.near_duplicates(docs).collect()} == want
        kept = M.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        assert sorted((x.doc_id, x.text, x.loser) for x in kept.collect()) == sorted([(1, [a, b][first], "xy"[first]), (3 - first, [a, b][1 - first], "x"), (4, c, "x")])


def test_minima_estimate_similarity():
    a, b = prose(400, 1), None
    b = " ".join(a.split()[:300] + prose(100, 2).split())
    w = Words(pa.array([a, b], pa.large_string()))
    s, t = w.shingles(3)
    sig = M.signatures(s, segment_starts(t, 2))
    true = M.jaccard(pa.array([a], pa.large_string()), pa.array([b], pa.large_string()))[0]
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15
    assert np.isclose(true, len(set(s[t == 0].tolist()) & set(s[t == 1].tolist())) / len(set(s.tolist())))


def test_components_are_the_connected_ones(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.id: x.root for x in M.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: g for i, g in root.items() if any(i in e for e in edges if e[0] != e[1])}


def test_hard_cases(spark, hard_docs, no_docs):
    got = {x.doc_id: x.group_id for x in M.near_duplicates(hard_docs).collect()}
    assert got == {1: 1, 2: 1, 6: 6, 7: 6, 9: 9, 10: 9} | ({8: 8} if 8 in got else {})
    kept = M.drop_near_duplicates(hard_docs)
    assert kept.columns == hard_docs.columns
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 8, 9, 11, None, None], key=str)
    assert M.near_duplicates(no_docs).count() == 0 and M.drop_near_duplicates(no_docs).count() == 0
