import random
import re
from collections import Counter

from tessella.llm import language_id as L


def grams(text):
    c = Counter()
    for word in re.findall(r"[^\W\d_]+", text):
        p = f" {word} "
        c.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n].strip())
    return c


def packed(g):
    out = 0
    for i in range(3):
        out = out << 21 | (0 if i >= len(g) else 1 if g[i] == " " else ord(g[i]))
    return out


def brute_distance(text, profile, top=L.TOP):
    ranked = sorted(((-n, packed(g)) for g, n in grams(text).items()))[:top]
    place = {int(g): i for i, g in enumerate(profile)}
    total = sum(min(abs(place[g] - i), top) if g in place else top for i, (_, g) in enumerate(ranked))
    return total / (len(ranked) * top) if ranked else 1.0


def test_distances_match_brute_force():
    texts = ["", "a", "the cat; sat 12 on the mat", "ß é--x le la", "日本語 テスト abc", "...", "der die das und der hund"]
    profiles = [L.profile(["the cat and the dog sat on the mat"]), L.profile(["der hund und die katze"])]
    assert L.profile(["ab ab c"]).tolist() == [g for _, g in sorted((-n, packed(g)) for g, n in grams("ab ab c").items())]
    got, size = L.distances(texts, profiles)
    for t, row, n in zip(texts, got, size):
        assert n == min(len(grams(t)), L.TOP)
        assert [round(x, 12) for x in row] == [round(brute_distance(t, p), 12) for p in profiles]


def test_many_letters_do_not_overflow():
    texts = ["".join(chr(0x4E00 + i) for i in range(k, k + 9000)) for k in range(0, 9000, 3000)]
    got, size = L.distances(texts * 40, [L.profile(texts[:1])])
    assert (size == L.TOP).all() and got[0, 0] == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = L.identify(docs.where("doc_id % 2 = 1"), L.fit(docs.where("doc_id % 2 = 0"))).join(docs, "doc_id").collect()
    assert sum(x.language == x.lang for x in got) >= 0.97 * len(got)
    assert all(x.keep for x in got)


def test_hard_cases(spark, hard_docs, no_docs):
    fitted = L.fit(hard_docs)
    got = L.identify(hard_docs, fitted).collect()
    assert len(got) == hard_docs.count()
    assert {(x.language, x.keep) for x in got if x.doc_id in (3, 4, 5)} == {(None, False)}
    kept = L.keep_identified(hard_docs, fitted)
    assert kept.dtypes == hard_docs.dtypes and kept.count() == sum(x.keep for x in got)
    assert L.fit(no_docs) == [] and L.identify(no_docs, []).count() == 0
    assert {x.language for x in L.identify(hard_docs, []).collect()} == {None} and L.keep_identified(hard_docs, []).count() == 0


def test_foreign_text_and_junk_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = random.Random(1)
    letters = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(n))
    italian = (
        "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte "
        "che nel pensier rinnova la paura tutti gli uomini nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri"
    )
    turkish = "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler"
    foreign = [italian, turkish, letters(3000), letters(40), "привет как дела", "这是一个句子"]
    own = ["the cat sat on the mat", "ein kleiner satz"]
    rows = spark.createDataFrame(list(enumerate(foreign + own)), "doc_id bigint, text string")
    kept = {x.doc_id for x in L.keep_identified(rows, L.fit(docs)).collect()}
    assert kept == {len(foreign), len(foreign) + 1}
