import os
import random

import pyarrow as pa
import pytest

from tessella.llm import sentencepiece_codec as S
from tessella.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=FILE)


def test_ids_are_the_librarys_and_decode_to_the_text(library, sf_dir):
    import pyarrow.parquet as pq

    r = random.Random(3)
    alphabet = [*"abcdefg  the ing  \n\té日本語😀ß.,'012", "  ", "   ", "▁▁"]
    texts = ["", "a", " ", "  ", "\n", "    x", *("".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(1500))]
    texts += ["".join(r.choice("aeioutnshrdl") for _ in range(r.randrange(1, 60))) for _ in range(1500)] + [" " * k for k in range(1, 70)] + ["a" * 50]
    texts += pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    c = S.Codec(FILE)
    ids, at = c.encode(pa.array(texts, pa.large_string()))
    b, begins = c.decode(ids, at)
    raw = b.tobytes()
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t), t
        assert raw[begins[k] : begins[k + 1]].decode() == t.replace("▁", " ")


def test_hard_cases(spark, hard_docs, no_docs, library):
    encoded = S.encode(hard_docs, FILE)
    got = sorted(((x.doc_id, x.ids) for x in encoded.collect()), key=str)
    want = sorted(((x.doc_id, None if x.text is None else library.encode(x.text)) for x in hard_docs.collect()), key=str)
    assert got == want
    back = sorted(((x.doc_id, x.text) for x in S.decode(encoded, FILE).collect()), key=str)
    assert back == sorted(((x.doc_id, x.text) for x in hard_docs.collect()), key=str)
    trip = S.round_trip(hard_docs, FILE).collect()
    assert all(x.exact is (None if x.doc_id == 3 else True) for x in trip if x.doc_id is not None)
    assert S.encode(no_docs, FILE).count() == 0 and S.round_trip(no_docs, FILE).count() == 0


def test_models_that_split_otherwise_are_refused(library):
    c = S.Codec(FILE)

    class Other:
        def encode(self, text):
            return library.encode(text.strip())

    with pytest.raises(ValueError):
        c._check(Other())
    c.id_of["a" + S.BLANK] = 5
    with pytest.raises(ValueError):
        c._check(library)
