import numpy as np
import pytest

from tessella.llm import embedding_dedup as E

KIND = "vec_id bigint, embedding array<float>, label int, id int, vec string, shard int, near int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2, 3) for i, v in rows], KIND)


def groups(x, ids, threshold=E.THRESHOLD):
    x = E.unit(np.asarray(x, np.float64))
    i, j = np.nonzero(x @ x.T >= threshold)
    root = E._roots(len(x), i, j)
    size = np.bincount(root, minlength=len(x))
    return {ids[k]: ids[r] for k, r in enumerate(root) if size[r] > 1}


def sample(n, near, seed, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * 0.8
    copies = x[rng.integers(0, n // 20, near)] + rng.normal(size=(near, dim)) * 0.05
    x = np.concatenate([x, copies]).astype(np.float32)
    return x[rng.permutation(len(x))]


def test_recall_of_the_search():
    x = E.unit(sample(2000, 400, 1))
    found = set()
    for a, b in E.search(x, E.build(x), E.THRESHOLD, E.BEAM):
        found.update(zip(a.tolist(), b.tolist()))
    i, j = np.nonzero(x @ x.T >= E.THRESHOLD)
    true = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    assert len(true) > 500 and len(true & found) >= 0.97 * len(true)


def test_groups_over_several_shards_match_brute_force(spark):
    x = sample(1500, 300, 2)
    audit = []
    got = {r.vec_id: r.group_id for r in E.near_duplicates(table(spark, [(k, v.tolist()) for k, v in enumerate(x)]), shard_rows=300, audit=audit).collect()}
    want = groups(x, list(range(len(x))))
    same = sum(got.get(k) == g for k, g in want.items())
    assert same >= 0.98 * len(want) and set(got) <= set(want)
    assert min(audit[-1][1:3]) >= E.LEAST_RECALL


@pytest.mark.parametrize("structured", [True, False])
def test_pairs_at_production_settings(spark, structured):
    # vectors without structure lie near the borders of shards; partners at any cosine above the threshold
    rng = np.random.default_rng(3)
    n, dim = 9000, 64
    x = rng.normal(size=(n, dim)) + (rng.normal(size=(40, dim))[rng.integers(0, 40, n)] * 1.5 if structured else 0)
    near = np.concatenate([E._partners(x[:600], c, k) for k, c in enumerate((0.951, 0.97, 0.99))])
    x = np.concatenate([x, near]).astype(np.float32)
    order = rng.permutation(len(x))
    x, audit = x[order], []
    got = {r.vec_id: r.group_id for r in E.near_duplicates(table(spark, [(k, v.tolist()) for k, v in enumerate(x)]), audit=audit).collect()}
    want = groups(x, list(range(len(x))))
    assert len(want) >= 2400 and set(got) <= set(want)
    assert sum(got.get(k) == g for k, g in want.items()) >= 0.97 * len(want)
    assert min(audit[-1][1:3]) >= E.LEAST_RECALL


def test_an_audit_that_fails_widens_the_search(spark, monkeypatch):
    # a beam of one without a margin loses a few of the partners made for the audit, the only ones in this table
    monkeypatch.setattr(E, "BEAM", 1)
    monkeypatch.setattr(E, "SIGMAS", 0.0)
    monkeypatch.setattr(E, "LEAST_RECALL", 0.999)
    x, audit = np.random.default_rng(1).normal(size=(1500, 32)).astype(np.float32), []
    assert E.near_duplicates(table(spark, [(k, v.tolist()) for k, v in enumerate(x)]), shard_rows=100, audit=audit).count() == 0
    assert len(audit) > 1 and audit[0][1] == 1.0 and audit[0][2] < 0.999 <= audit[-1][2]
    assert audit[-1][3] == audit[0][3] * 2 ** (len(audit) - 1) and audit[-1][4] == 2 ** (len(audit) - 1)


def test_the_smallest_of_a_repeated_id_counts(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0])]
    assert sorted(map(tuple, E.near_duplicates(table(spark, rows)).collect())) == [(1, 1), (3, 1)]


def test_rows_are_those_of_the_sql(spark):
    import duckdb
    import pyarrow as pa

    x = sample(300, 60, 4)
    embeddings = pa.table({"vec_id": list(range(len(x))), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))})  # noqa: F841
    want = duckdb.sql(E.SQL).fetchall()
    got = E.near_duplicates(table(spark, [(k, v.tolist()) for k, v in enumerate(x)])).collect()
    assert len(want) > 50 and sorted(want) == sorted(map(tuple, got))


def test_pruning_leaves_out_what_a_kept_edge_is_near_to():
    x = E.unit(np.array([[1, 0], [0.99, 0.1], [0.98, 0.15], [0, 1]], np.float32))
    cand = np.array([[1, 2, 3]])
    out = E.robust_prune(x, np.array([0]), cand, x[[0]] @ x[cand[0]].T, 3)
    assert 1 in out and 2 not in out


@pytest.mark.parametrize("rows", [1, 2])
def test_small_tables(spark, rows):
    got = E.near_duplicates(table(spark, [(k + 5, [1.0, 2.0]) for k in range(rows)])).collect()
    assert sorted(map(tuple, got)) == ([] if rows == 1 else [(5, 5), (6, 5)])


def test_hard_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (11, [-1.0, 0.0])]
    got = {r.vec_id: r.group_id for r in E.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 10: 1}
    assert E.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
