import random

import numpy as np
import pyarrow as pa

from tessella.llm import toxicity as X
from tessella.llm.text import Words

from .conftest import prose


def arr(texts):
    return Words(pa.array(texts, pa.large_string()))


def rows_of(texts):
    text, h = X.features(arr(texts))
    return [h[text == i] for i in range(len(texts))]


def test_pairs_that_no_additive_weights_tell_apart():
    # toxic where exactly both or neither of the words are there: no linear model is right on more than 3 in 4
    r = random.Random(3)
    make = lambda: (lambda a, b: (prose(12, r.randrange(10**6), 40) + " insult" * a + " group" * b, int(a == b)))(r.random() < 0.5, r.random() < 0.5)
    data = [make() for _ in range(1200)]
    machine = X.train(rows_of([t for t, _ in data[:900]]), np.array([y for _, y in data[:900]]))
    p = machine.scores(arr([t for t, _ in data[900:]])) > 0.5
    assert np.mean(p == np.array([y for _, y in data[900:]])) > 0.9


def test_pairs_among_many_words_at_production_settings():
    # both words are neutral on their own, among thousands of others
    r = random.Random(5)
    rows = [(lambda a, b: (prose(60, r.randrange(10**6), 3000) + " insult" * a + " group" * b, int(a != b)))(r.random() < 0.5, r.random() < 0.5) for _ in range(5000)]
    machine = X.train(rows_of([t for t, _ in rows[:4000]]), np.array([y for _, y in rows[:4000]]))
    p = machine.scores(arr([t for t, _ in rows[4000:]])) > X.CUTOFF
    assert np.mean(p == np.array([y for _, y in rows[4000:]])) > 0.9


def test_scores_are_the_sum_over_all_pairs():
    texts = ["a b c", "a a b", "", "zz"]
    rng = np.random.default_rng(1)
    m = X.Machine(-0.3, rng.normal(size=1 << X.HASH_BITS), rng.normal(size=(1 << X.HASH_BITS, 3)))
    for t, got in zip(texts, m.scores(arr(texts))):
        own = rows_of([t])[0].tolist()
        z = m.w0 + sum(m.w[i] for i in own) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(own) for j in own[k + 1 :])
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-5


def test_held_out_accuracy(spark, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{base}/{n}.parquet") for n in ("documents", "labels"))
    machine = X.fit(docs, labels.where("doc_id % 4 <> 0"))
    got = X.score(docs, machine).join(labels.where("doc_id % 4 = 0"), "doc_id").select(X.F.col("score"), labels.toxic.alias("y")).collect()
    flagged = [g.score > X.CUTOFF for g in got]
    y = [g.y == 1 for g in got]
    assert sum(a and b for a, b in zip(flagged, y)) >= 0.8 * sum(y)
    assert sum(a and not b for a, b in zip(flagged, y)) <= 0.01 * (len(y) - sum(y))


def test_hard_cases(spark, hard_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (8, 1, 0), (8, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = X.score(hard_docs, X.fit(hard_docs, labels)).collect()
    assert len(got) == hard_docs.count() and all(0 <= g.score <= 1 for g in got)
    none = labels.where("false")
    assert all(g.score < 1e-6 and not g.toxic for g in X.score(hard_docs, X.fit(hard_docs, none)).collect())
    assert X.score(no_docs, X.fit(no_docs, none)).count() == 0
