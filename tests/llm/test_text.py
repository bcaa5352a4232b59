import re

import pyarrow as pa

from tessella.llm import text
from tessella.llm.text import Words, slices


def arr(*texts):
    return pa.array(texts, pa.large_string())


def test_words_are_those_of_a_regular_expression():
    texts = ["", "The CAT, the dog", "éa ß-x 12a", "  ", "日本 x", "a"]
    w = Words(arr(*texts))
    want = [re.findall(rb"[0-9a-z\x80-\xff]+", t.lower().encode()) for t in texts]
    assert w.count.tolist() == [len(x) for x in want]
    by: dict[bytes, int] = {}
    for word, h in zip((x for ws in want for x in ws), w.hash.tolist()):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_hashes_do_not_depend_on_the_slice(monkeypatch):
    long = " ".join(f"w{i}" for i in range(3000))
    whole = Words(arr("x y", long)).hash.tolist()
    monkeypatch.setattr(text, "CHUNK_BYTES", 64)
    assert Words(arr("x y", long)).hash.tolist() == whole


def test_shingles_of_short_texts_are_their_words_and_stay_apart():
    s, t = Words(arr("a b", "", "a b", "a", "a b c d")).shingles(3)
    assert t.tolist() == [0, 2, 3, 4, 4]
    assert s[0] == s[1] and len(set(s.tolist())) == 4


def test_slices_cover_all_rows_in_order():
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["aaa", None, "b" * 50, "c"])], names=["i", "text"])
    parts = [p.column(0).to_pylist() for p in slices(b, "text", 10)]
    assert [x for p in parts for x in p] == [1, 2, 3, 4] and len(parts) > 1
