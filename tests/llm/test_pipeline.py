import random

import pyarrow as pa

import corpus_pipeline as P
from tessella.llm.language_id import _top, profile
from tessella.llm.text import Words

from .conftest import prose
from .test_op1_minhash_dedup import brute as groups
from .test_op6_packing import brute as packed, keys, windows
from .test_op9_repetition import brute as repeats


def test_run_matches_brute_force(spark, tmp_path):
    r = random.Random(8)
    texts = [prose(r.choice([30, 80, 200]), k) for k in range(30)]
    texts += [t + " tail" for t in texts[:6]] + texts[6:9] + ["spam and eggs now " * 30, "123 456", ""]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(90, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = windows(P.run(spark, str(tmp_path)))
    kept = []
    for i, t, *_ in rows:
        words = (t or "").lower().split()
        covered, longest = repeats(words, 8)
        letters = any(c.isalpha() for c in t or "")
        if words and covered <= 0.5 * len(words) and longest <= 100 and letters:
            kept.append((i, t))
    of = groups(kept)
    kept = sorted((i, t) for i, t in kept if of.get(i, i) == i)
    assert got == packed(kept, keys(spark, kept), 4096, 2048, 64)


def test_stages_keep_the_columns_of_documents(spark, hard_docs, no_docs, sf_dir):
    for docs in (hard_docs, no_docs):
        for _, stage in P.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).dtypes == docs.dtypes
    assert [len(P.STAGES), P.ORACLE_SQL] == [4, None]


def test_profiles_rank_by_count_then_code():
    doc, gram, rank = _top(["b a b", "a"], 300)
    assert gram[doc == 0].tolist() == profile(["b a b"]).tolist() and rank.tolist() == [*range((doc == 0).sum()), *range((doc == 1).sum())]
    assert Words(pa.array([""], pa.large_string())).count.tolist() == [0]
