import os
import random
import re
import subprocess
import sys
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from tessella.llm import packing
from tessella.llm.packing import GRAIN, Shard, _best, _counted, _index, _left, _postings, choose_seeds, idf, pack_windows, weights
from tessella.llm.text import slices, strings

from .conftest import prose


def keys(spark, rows):
    """The hashes by which ties are broken."""
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "k int, id bigint, text string")
    return [int(r.h) % 2**64 for r in df.selectExpr("k", "xxhash64(cast(id as string), text) h").orderBy("k").collect()]


def brute(rows, key, window, seeds, near):
    """Every seed against every unused piece, word by word: {window: [(id, first word, words), ...] in order of place}."""
    keep = [k for k, (_, t) in enumerate(rows) if re.search("[a-z0-9]", (t or "").lower())]
    words = [re.findall(r"[a-z0-9]+", rows[k][1].lower()) for k in keep]
    ids, key = [rows[k][0] for k in keep], np.array([key[k] for k in keep], np.uint64)
    count = np.array([len(w) for w in words], np.int64)
    n, mean, rest, tf = len(words), count.mean() if keep else 1.0, count % window, [Counter(w) for w in words]
    df = Counter(w for t in words for w in set(t))

    def score(q, d):
        return sum(float(weights(np.array([float(tf[d][w])]), count[[d]], idf(n, np.array([df[w]])).astype(np.float32).astype(float), mean)[0]) for w in set(words[q]) if df[w] > 1 and tf[d][w])

    out = [[(ids[d], a, window)] for d in range(n) for a in range(0, int(count[d] - rest[d]), window)]
    used = rest == 0
    while not used.all():
        chosen = choose_seeds(rest, key, used, window)
        used[chosen] = True
        room = {int(s): window - int(rest[s]) for s in chosen}
        own = {int(s): [(ids[s], int(count[s] - rest[s]), int(rest[s]))] for s in chosen}
        open_ = [int(s) for s in chosen]
        while open_ and not used.all():
            again = []
            open_ = [s for s in open_ if room[s] >= rest[~used].min()]
            for a in range(0, len(open_), seeds):
                lists = {}
                for s in open_[a : a + seeds]:
                    fits = [d for d in range(n) if not used[d] and rest[d] <= room[s] and score(s, d) > 0]
                    lists[s] = sorted(fits, key=lambda d: (-score(s, d), key[d], d))[:near]  # noqa: B023
                for s, found in lists.items():
                    for d in found:
                        if not used[d] and rest[d] <= room[s]:
                            used[d] = True
                            room[s] -= int(rest[d])
                            own[s].append((ids[d], int(count[d] - rest[d]), int(rest[d])))
                    if len(found) == near:
                        again.append(s)
            open_ = again
        out += own.values()
    return sorted(out)


def windows(df):
    by = defaultdict(list)
    for x in df.collect():
        by[x.window].append((x.place, x.doc_id, x.first_word, x.n_words))
    return sorted([t[1:] for t in sorted(rows)] for rows in by.values())


@pytest.mark.parametrize("shard_bytes, seeds, near", [(10**6, 1000, 1000), (2000, 7, 5), (2000, 3, 2)])
def test_windows_match_brute_force_whatever_the_shards(spark, shard_bytes, seeds, near):
    r = random.Random(5)
    texts = [" ".join(f"w{int(r.random() ** 2 * 60)}" for _ in range(r.choice([0, 1, 3, 10, 25, 40, 90]))) for _ in range(120)]
    rows = list(enumerate(texts + ["alone here", "Alone, there"] + texts[:20]))
    got = pack_windows(spark.createDataFrame(rows, "doc_id bigint, text string"), window=40, seeds=seeds, near=near, shard_bytes=shard_bytes)
    assert windows(got) == brute(rows, keys(spark, rows), 40, seeds, near)


def test_neighbours_share_a_word_and_score_as_bm25(spark):
    rows = [(1, "a b c d e f g h i j k l"), (2, "a b x"), (3, "x x y z")]
    got = {x.doc_id: x for x in pack_windows(spark.createDataFrame(rows, "doc_id bigint, text string"), window=20).collect()}
    assert sum(x.place == 0 and x.score is None for x in got.values()) == len({x.window for x in got.values()})
    for x in got.values():
        if x.place:
            seed = next(y for y in got.values() if y.window == x.window and not y.place)
            words = [t.split() for _, t in rows]
            df = Counter(w for t in words for w in set(t))
            own = Counter(words[x.doc_id - 1])
            want = sum(np.log1p((3 - df[w] + 0.5) / (df[w] + 0.5)) * own[w] * 2.2 / (own[w] + 1.2 * (0.25 + 0.75 * sum(own.values()) / (19 / 3))) for w in set(words[seed.doc_id - 1]) if df[w] > 1 and own[w])
            assert abs(x.score - want) < 12 / GRAIN


def test_words_are_counted_in_little_memory():
    # 16 MB of text, as a shard has; numpy reports its arrays to tracemalloc
    texts = pa.array([prose(1000, k, 20_000) for k in range(50)] * 48, pa.string())
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    tracemalloc.start()
    count, words, many, text, tf = _postings([_counted(strings(part.column(0))) for part in slices(batch, "text")])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * texts.nbytes
    whole = _postings([_counted(strings(texts))])
    assert all((a == b).all() for a, b in zip((count, words, many, text, tf), whole))


def test_a_shard_holds_only_pieces_that_have_room():
    # what is left out fits no window; what stays scores as before
    r = random.Random(3)
    texts = pa.array([" ".join(f"w{int(r.random() ** 2 * 90)}" for _ in range(r.randrange(1, 80))) for _ in range(200)], pa.large_string())
    count, words, many, text, tf = _postings([_counted(texts)])
    row = {"count": count.astype(np.int64), "words": words, "size": many.astype(np.int32), "text": text.astype(np.uint16), "tf": tf}
    row = {k: x.tobytes() for k, x in row.items()}
    used, rarity = np.arange(200) % 7 == 0, idf(200, many)
    asked = [np.sort(np.array(r.sample(range(len(words)), 20), np.int32)) for _ in range(9)]
    make = lambda most: Shard(row, used, count, most, words, rarity, float(count.mean()))
    whole, small, later = make(10**6), make(15), make(10**6)
    later.shrink(79)
    assert later.n == whole.n == int((~used).sum())
    later.shrink(15)
    want = np.flatnonzero(~used & (count <= 15))
    for shard in (small, later):
        assert shard.piece.tolist() == want.tolist() and len(shard.doc) < len(whole.doc) / 4
        assert (shard.scores(asked) == whole.scores(asked)[:, np.searchsorted(whole.piece, want)]).all()
    later.shrink(0)
    assert later.n == 0


def test_a_shard_holds_one_kind_of_documents(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(r.random() ** 2 * 90)}" for _ in range(60))) for i in range(400)]
    slim = spark.createDataFrame(rows, "id bigint, text string").coalesce(1).select("id", F.xxhash64("id").alias("key"), "text")
    shards = [x.ids for x in _index(slim, T.LongType(), 20_000).select("ids").collect()]
    assert sorted(i for ids in shards for i in ids) == list(range(400))
    assert len(shards) == 2 and all(len({i % 2 for i in ids}) == 1 for ids in shards)


def test_no_score_exceeds_its_bound():
    r = random.Random(6)
    texts = pa.array([" ".join(f"w{int(r.random() ** 2 * 90)}" for _ in range(r.randrange(1, 80))) for _ in range(200)], pa.large_string())
    count, words, many, text, tf = _postings([_counted(texts)])
    row = {"count": count.astype(np.int64), "words": words, "size": many.astype(np.int32), "text": text.astype(np.uint16), "tf": tf}
    words = np.sort(np.append(words, np.uint64(7)))  # a word that the shard doesn't have
    shard = Shard({k: x.tobytes() for k, x in row.items()}, np.zeros(200, bool), count, 10**6, words, np.ones(len(words)), float(count.mean()))
    asked = [np.sort(np.array(r.sample(range(len(words)), k), np.int32)) for k in (1, 2, 20, 50)] + [np.flatnonzero(words == 7).astype(np.int32)]
    bound = shard.bounds(np.concatenate(asked), np.cumsum([0] + [len(x) for x in asked])[:-1])
    assert (shard.scores(asked) <= bound[:, None]).all() and bound[0] == shard.scores(asked)[0].max() and bound[-1] == 0


def test_an_index_written_anew_holds_what_is_left(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(r.random() ** 2 * 90)}" for _ in range(60))) for i in range(400)]
    slim = spark.createDataFrame(rows, "id bigint, text string").repartition(4).select("id", F.xxhash64("id").alias("key"), "text")
    index = _index(slim, T.LongType(), 20_000)
    before = index.orderBy("shard").collect()
    begin = dict(zip((x.shard for x in before), np.cumsum([0] + [len(x.ids) for x in before]).tolist()))
    used = np.arange(400) % 3 > 0
    index = index.drop("ids").withColumn("doc", F.lit(None).cast("binary"))

    def postings(found):
        out = set()
        for x in found:
            doc = np.frombuffer(x.doc, np.int64) if x.doc else begin[x.shard] + np.arange(len(x["count"]) // 8)
            word, text = np.repeat(np.frombuffer(x.words, np.uint64), np.frombuffer(x["size"], np.int32)), np.frombuffer(x.text, np.uint16)
            key, count = np.frombuffer(x.key, np.uint64)[text], np.frombuffer(x["count"], np.int64)[text]
            out |= set(zip(doc[text].tolist(), key.tolist(), count.tolist(), word.tolist(), np.frombuffer(x.tf, np.uint16).tolist()))
        return out

    before = index.collect()
    left = _left(index.repartition(1), begin, used, 10**6).collect()
    assert postings(left) == {x for x in postings(before) if not used[x[0]]}
    assert len(left) == 2 < len(before)


def test_windows_match_brute_force_when_the_index_is_written_anew(spark, monkeypatch):
    made = []
    monkeypatch.setattr(packing, "SMALL", 5)
    monkeypatch.setattr(packing, "_left", lambda *x: made.append(1) or _left(*x))
    r = random.Random(6)
    rows = list(enumerate(" ".join(f"w{int(r.random() ** 2 * 60)}" for _ in range(r.choice([1, 3, 10, 25, 40, 90]))) for _ in range(100)))
    got = pack_windows(spark.createDataFrame(rows, "doc_id bigint, text string"), window=40, seeds=7, near=5, shard_bytes=2000)
    assert windows(got) == brute(rows, keys(spark, rows), 40, 7, 5) and len(made) > 1


def test_best_candidates_go_by_score_then_key():
    r = np.random.default_rng(1)
    seed, score, key = r.integers(0, 9, 3000).astype(np.int32), r.integers(1, 40, 3000).astype(np.float32), r.integers(0, 5, 3000).astype(np.uint64)
    doc = np.arange(3000)
    order = np.lexsort((doc, key, -score, seed))
    want = [k for s in range(9) for k in [k for k in order.tolist() if seed[k] == s][:20]]
    assert _best(seed, doc, score, key, 20).tolist() == want
    assert not len(_best(seed[:0], doc[:0], score[:0], key[:0], 20))


_GROWN = """
import os, pathlib, sys, tempfile
from pyspark.sql import SparkSession
from tessella.llm.lineage import collect_garbage

spark = SparkSession.builder.master("local-cluster[1,1,1500]").config("spark.executor.memory", "900m").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
spark.range(3000000).selectExpr("repeat(cast(id as string), 40) x").repartition(4).selectExpr("max(x)").collect()

def resident():
    for p in pathlib.Path("/proc").glob("[0-9]*"):
        try:
            cmd = (p / "cmdline").read_text()
            if "CoarseGrainedExecutorBackend" in cmd and spark.sparkContext.applicationId in cmd:
                return int(next(x for x in (p / "status").read_text().splitlines() if x.startswith("VmRSS")).split()[1]) >> 10
        except OSError:
            pass

before = resident()
collect_garbage(spark)
print("MB", before, resident())
spark.stop()
"""


def test_executors_give_back_their_garbage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_", "JAVA_TOOL"))} | {"PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")]), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    out = subprocess.run([sys.executable, "-c", _GROWN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180).stdout
    before, after = map(int, re.search(r"MB (\d+) (\d+)", out).groups())
    assert after < before - 150


def test_every_word_is_in_one_window(spark, hard_docs, no_docs):
    rows = pack_windows(hard_docs, window=500).collect()
    size = defaultdict(int)
    for x in rows:
        size[x.window] += x.n_words
    assert max(size.values()) <= 500
    want = sum(len(re.findall("[a-z0-9]+", x.text or "")) for x in hard_docs.collect())
    assert sum(size.values()) == want
    spans = sorted((x.first_word, x.n_words) for x in rows if x.doc_id == 6)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) == 60_000
    assert not {x.doc_id for x in rows} & {3, 4, 5} and pack_windows(no_docs).count() == 0
