import random

import pyarrow as pa

from tessella.llm import repetition as R
from tessella.llm.text import Words

from .conftest import prose


def brute(words, least):
    covered, longest = set(), 0
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            covered.update(range(i, i + best))
            longest = max(longest, best)
    return len(covered), longest


def test_repeats_match_brute_force():
    r = random.Random(1)
    for _ in range(25):
        texts = []
        for _ in range(6):
            words = [f"w{r.randrange(r.choice([1, 2, 5, 60]))}" for _ in range(r.randrange(60))]
            if len(words) > 20 and r.random() < 0.6:
                k, p = r.randrange(5, 20), r.randrange(len(words) - 20)
                words += words[p : p + k] + ["x"] + words[p : p + k // 2]
            texts.append(" ".join(words))
        for least in (2, 4, 8):
            got = R.repeats(Words(pa.array(texts, pa.large_string())), least)
            assert list(zip(*(g.tolist() for g in got))) == [brute(t.split(), least) for t in texts]


def test_rules_reject_repetition_and_keep_prose(spark):
    rows = [(1, prose(300, 1)), (2, "buy this now today " * 60), (3, prose(100, 2) + "\n" + prose(60, 3) + "\n" + prose(100, 4) + "\n" + prose(60, 3))]
    got = {x.doc_id: x for x in R.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].keep for i in (1, 2, 3)] == [True, False, True]
    assert got[3].longest_repeat == 60 and got[3].covered_words == 120


def test_hard_cases(spark, hard_docs, no_docs):
    got = R.quality_rules(hard_docs).collect()
    assert len(got) == hard_docs.count()
    assert {x.doc_id: x.keep for x in got if x.doc_id in (3, 4, 5, 6)} == {3: False, 4: False, 5: False, 6: True}
    kept = R.keep_quality(hard_docs)
    assert kept.columns == hard_docs.columns and kept.dtypes == hard_docs.dtypes
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted([1, 2, None, 6, 7, 8, 8, 9, 10, 11], key=str)
    assert R.quality_rules(no_docs).count() == 0 and R.keep_quality(no_docs).count() == 0
