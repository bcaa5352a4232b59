import random

import pytest

#: Columns that operators make themselves, here as further columns of the input.
CLASHING = "id string, keep string, language int, group_id string, band int, shard string, u int, v int, score string, toxic string, rep int, line int"


def prose(n: int, seed: int, vocabulary: int = 5000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    extra = ("e", "k", 1, "g", 2, "s", 3, 4, "c", "t", 5, 6)
    long = prose(60_000, 1, 100_000)
    texts = [(1, prose(120, 2)), (2, prose(120, 2)), (3, None), (4, ""), (5, "..."), (None, prose(90, 3)), (6, long), (7, long + " tail"), (8, prose(150, 4)), (8, prose(150, 4)), (9, "one"), (10, "one"), (11, prose(200, 5)), (None, None)]
    rows = [(i, t, None if k % 2 else "en", None, None if t is None else len(t), *(extra if k % 3 else (None,) * 12)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASHING).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
