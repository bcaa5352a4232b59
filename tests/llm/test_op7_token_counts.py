import base64
import os
import random

import pytest
import regex

from tessella.llm import token_counts as C
from tessella.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary file")
ALPHABET = [*"abtsdmlrve'' '' \n\t  12é日,.! 　\u0085\x1c", "'s", "'ll", "'re ", " 't", "don't"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("t", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})


def some(r, n):
    return "".join(r.choice(ALPHABET) for _ in range(n))


def test_counts_are_the_librarys(library):
    r, c = random.Random(5), C.Counter(FILE)
    texts = ["", "'", " '", "''s", "'tis", "x 's", "\n's", "!!'s", "  ", "a \n b", *(some(r, r.randrange(30)) for _ in range(3000))]
    chars, tokens, at = c.leaves(texts)
    for t, i, j in zip(texts, at[:-1], at[1:]):
        assert tokens[i:j].sum() == len(library.encode_ordinary(t))
        assert chars[i:j].tolist() == [m.end() - m.start() for m in regex.finditer(C._PATTERN, t)]


def test_edits_give_what_counting_anew_gives():
    r, c = random.Random(6), C.Counter(FILE)
    for _ in range(300):
        t = some(r, r.choice([0, 5, 60, 900]))
        chars, tokens, _ = c.leaves([t])
        tree = C.Tree(t, chars.tolist(), tokens.tolist(), c.one)
        for _ in range(5):
            at, gone, new = r.randrange(len(tree.text) + 3), r.choice([0, 1, 5, 40, 400]), some(r, r.choice([0, 1, 3, 20, 400]))
            before = tree.text
            tree.edit(at, gone, new)
            at = min(at, len(before))
            assert tree.text == before[:at] + new + before[at + gone :]
            chars, tokens, _ = c.leaves([tree.text])
            assert [x for b in tree.chars for x in b] == chars.tolist() and tree.total == tokens.sum()


def test_an_edit_reencodes_little():
    c = C.Counter(FILE)
    t = " ".join(f"word{i}" for i in range(20_000))
    chars, tokens, _ = c.leaves([t])
    tree = C.Tree(t, chars.tolist(), tokens.tolist(), c.one)
    assert tree.edit(len(t) // 2, 4, "new") < 12


def test_hard_cases(spark, hard_docs, no_docs, library):
    edits = spark.createDataFrame([(1, 2, 0, 3, "b"), (1, 1, 10, 0, "first "), (4, 1, 99, 5, "now text"), (6, 1, 5, 10**9, ""), (77, 1, 0, 0, "x"), (8, 1, None, 0, "x"), (None, 1, 0, 0, "x")], "doc_id bigint, seq bigint, at bigint, gone bigint, new string")
    got = C.count_edited(C.with_edits(hard_docs, edits), FILE).collect()
    assert len(got) == hard_docs.count()
    by = {x.doc_id: x for x in got}
    text = {x.doc_id: x.text for x in hard_docs.collect()}
    count = lambda t: len(library.encode_ordinary(t or ""))
    assert all(by[i].n_tokens == count(text[i]) for i in (1, 2, 3, 4, 5, 6, 8))
    once = text[1][:10] + "first " + text[1][10:]
    assert by[1].n_tokens_edited == count("b" + once[3:]) and by[4].n_tokens_edited == count("now text")
    assert by[6].n_tokens_edited == count(text[6][:5]) and (by[8].n_edits, by[8].n_tokens_edited) == (0, count(text[8]))
    assert C.count_edited(C.with_edits(no_docs, edits), FILE).count() == 0
    sampled = C.count_edited(C.sample_edits(hard_docs), FILE).collect()
    assert len(sampled) == len(got) and all(x.n_edits == 3 for x in sampled if x.doc_id is not None)


def test_trees_that_last(spark, hard_docs):
    kind = "doc_id bigint, seq bigint, at bigint, gone bigint, new string"
    leaves = C.leaf_table(hard_docs.where("doc_id <> 8"), FILE)
    assert {r.doc_id: r.n for r in leaves.selectExpr("doc_id", "aggregate(tokens, 0, (a, x) -> a + x) n").collect() if r.doc_id} == {r.doc_id: r.n_tokens for r in C.count_edited(hard_docs.where("doc_id <> 8").withColumn("edits", C.F.lit(None)), FILE).collect() if r.doc_id}
    batches = [[(6, 1, 100, 5, " it's"), (6, 2, 90_000, 0, "\n\n12"), (3, 1, 0, 0, "new text"), (99, 1, 0, 0, "x")], [(6, 1, 5, 2, ""), (3, 1, 3, 1, "  "), (None, 1, 0, 0, "x"), (1, 1, None, 0, "x")]]
    for batch in batches:
        after = C.edit_leaves(leaves, spark.createDataFrame(batch, kind), FILE)
        rows = {r.doc_id: r for r in after.collect()}
        assert set(rows) == {i for i, *_ in batch if i not in (None, 99)}
        fresh = {r.doc_id: r for r in C.leaf_table(after.select("doc_id", "text"), FILE).collect()}
        assert all(rows[i].chars == fresh[i].chars and rows[i].tokens == fresh[i].tokens and rows[i].n_tokens == sum(fresh[i].tokens) for i in rows)
        assert rows[6].n_reencoded < 20
        # the next batch starts from what this one left
        kept = leaves.join(after.select("doc_id"), "doc_id", "left_anti").unionByName(after.select("doc_id", "text", "chars", "tokens"))
        leaves = spark.createDataFrame(kept.collect(), leaves.schema)
