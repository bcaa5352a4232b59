"""Packing documents into training windows by lexical retrieval.

A document longer than the window first fills windows of its own; what remains of it, or
all of a shorter one, is a piece. Pieces of more than half a window seed a window each,
for no two of them fit together, and of the others those of smallest hash seed as many
more as all the pieces' words need. Each seed queries a BM25 index of the whole table with
all distinct words of its document; its unused neighbours fill its window greedily in
order of score (ties by hash), each taken whole where it still fits. Neighbours share a
word with the seed. When the windows take no more, seeds are drawn anew from what is left.

The index is cut into shards of about `SHARD_BYTES` of text, which decide about cost only:
document frequencies, number and mean length are those of the whole table, and every seed
queries every shard. A shard holds documents of one kind, a language for instance, as far
as its task can tell; a seed of another kind has few words there, so it costs little, and
nothing where these can't reach the best that it has got (the bound is exact). `SEEDS` seeds are looked up at a time: the shards return the `NEAR`
best unused pieces that fit (all of them, not those of a sample), the driver fills these
windows one after the other, and a window that its `NEAR` best don't fill asks again once
all seeds had their turn, until it is full or nothing that fits shares a word with it.
Once half of the pieces in the index are used it is written anew without them, so that the
look-ups that follow read less; like shards are put together then.
Weights are multiples of 1/`GRAIN`, so that sums of them are exact in single precision:
results depend neither on shards nor on the order of additions.

Work grows with windows times documents, the square of the table; that is the price of
exact retrieval with whole documents as queries. The driver holds three numbers and a bit
a document and the candidates of `SEEDS` seeds.

Cases: null, empty and wordless texts have nothing to pack and are in no window; rows
that repeat an id, or have a null id, are packed each on their own (rows equal in id and
text are interchangeable); equal texts tie and go by their hash of id and text; texts of
any length are packed whole, each word in exactly one window; an empty table has no
windows; further columns are ignored.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.partitioning import spread
from .lineage import collect_garbage, shared_folder, shared_table
from .text import Words, slices, strings

#: Words in a window, and bytes of text in a shard of the index.
WINDOW, SHARD_BYTES = 4096, 16 << 20
K1, B = 1.2, 0.75
#: Seeds that are looked up at a time, candidates that each gets, seeds that a shard scores at once, and those whose rarer words it adds up at once.
SEEDS, NEAR, BATCH, FEW = 2048, 64, 512, 64
#: A word that at least one of so many pairs of a query and a piece share is scored by a matrix product, of which so many words are held.
DENSE, ROWS = 256, 2048
#: Postings that are weighed at once, and look-ups after which the executors' garbage is collected.
PART, EVERY = 1 << 17, 4
#: The index is written anew without its used pieces when these are half of it, unless it has no more pieces than this.
SMALL = 4096
#: Kinds of documents that a task of the index tells apart at most, documents and frequent words by which it does, and the cosine from which two kinds are one.
KINDS, LEARN, MARKS, ALIKE = 8, 2000, 256, 0.5
#: Weights are rounded to multiples of one so-manyth.
GRAIN = 256

#: A row group for each shard (else the size is looked at every 100 rows), so that splits hold equally much.
_GROUPS = {"parquet.block.size": str(1 << 20), "parquet.page.size.row.check.min": "1"}
_COLUMNS = ["count", "words", "size", "text", "tf"]
_KINDS = {"doc": np.int64, "count": np.int64, "key": np.uint64, "words": np.uint64, "size": np.int32, "text": np.uint16, "tf": np.uint16, "shared": np.uint64, "df": np.int64}
#: Of a word in one text no more occurrences are told apart, and no more texts are in a shard.
_MOST = 0xFFFF


def idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def weights(tf: np.ndarray, length: np.ndarray, rarity: np.ndarray, mean: float) -> np.ndarray:
    """BM25 of one query word, in multiples of 1/GRAIN."""
    return np.rint(rarity * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))) * GRAIN).astype(np.float32)


def _counted(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Words in each text; the words, in which texts they are and how often, sorted by word and text."""
    w = Words(texts)
    count, word, text = w.count, w.hash, w.text.astype(np.int32)
    del w
    order = np.argsort(word, kind="stable")
    word, text = word[order], text[order]
    del order
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    tf = np.minimum(np.diff(np.append(at, len(word))), _MOST)
    return count, word[at], text[at], tf.astype(_KINDS["tf"])


def _postings(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of consecutive texts, `_counted` in parts: words in each text; sorted words, in how many texts each is, and these texts with how often they have it."""
    count, word, tf = (np.concatenate([x[k] for x in parts]) for k in (0, 1, 3))
    first = np.cumsum([0] + [len(x[0]) for x in parts])
    text = np.concatenate([x[2] + np.int32(a) for x, a in zip(parts, first)])
    order = np.argsort(word, kind="stable")
    word, text, tf = word[order], text[order], tf[order]
    del order
    new = np.ones(len(word), bool)
    new[1:] = word[1:] != word[:-1]
    at = np.flatnonzero(new)
    return count, word[at], np.diff(np.append(at, len(word))), text, tf


def kinds(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words that tell kinds of texts apart and the kinds' centres, learnt from some texts, `_counted` in parts."""
    count, word, many, text, _ = _postings(parts)
    mark = np.sort(np.argsort(-many, kind="stable")[:MARKS])
    x = _marked(len(count), np.repeat(word, many), text, word[mark])
    x = x[x.any(axis=1)]
    if not len(x):
        return word[mark], np.zeros((1, len(mark)), np.float32)
    centres = x[:1]
    for _ in range(KINDS - 1):  # the text least like those chosen is the next
        centres = np.vstack([centres, x[[int((x @ centres.T).max(axis=1).argmin())]]])
    for _ in range(5):
        of = (x @ centres.T).argmax(axis=1)
        centres = np.array([x[of == k].sum(axis=0) for k in np.unique(of)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    own = np.bincount((x @ centres.T).argmax(axis=1), minlength=len(centres))
    kept = []
    for k in np.argsort(-own, kind="stable").tolist():
        if not kept or (own[k] * 50 >= len(x) and (centres[kept] @ centres[k]).max() < ALIKE):
            kept.append(k)
    return word[mark], centres[kept]


def _marked(n: int, word: np.ndarray, text: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """(texts, marks) which of the marks texts have, as vectors of length 1."""
    x = np.zeros((n, len(marks)), np.float32)
    i = np.minimum(np.searchsorted(marks, word), max(len(marks) - 1, 0))
    known = marks[i] == word if len(marks) else np.zeros(len(word), bool)
    x[text[known], i[known]] = 1
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Their rows, in which blobs are views of Arrow's memory."""
    for batch in batches:
        for i in range(len(batch)):
            yield {n: c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def _blob(row: dict, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(row[n] or b"", _KINDS[n]) for n in names]


class Shard:
    """The unused pieces of a shard that have room in some window, and what the words of some queries weigh in them."""

    def __init__(self, row: dict, used: np.ndarray, rest: np.ndarray, most: int, vocabulary: np.ndarray, rarity: np.ndarray, mean: float):
        count, words, size, text, tf = _blob(row, *_COLUMNS)
        piece = np.flatnonzero(~used & (rest <= most))
        place = np.full(len(count), -1, np.int32)
        place[piece] = np.arange(len(piece))
        i = np.minimum(np.searchsorted(words, vocabulary), len(words) - 1)
        known = words[i] == vocabulary
        of = np.full(len(words), -1, np.int32)
        of[i[known]] = np.flatnonzero(known)
        term = np.repeat(of, size)
        keep = term >= 0
        keep &= place[text] >= 0
        term, text, tf = term[keep], text[keep], tf[keep]
        weight = np.empty(len(term), np.float32)
        for a in range(0, len(term), PART):  # in double precision, of which no more than a part is held
            b = a + PART
            weight[a:b] = weights(tf[a:b].astype(np.float64), count[text[a:b]], rarity[term[a:b]], mean)
        self._hold(piece, rest[piece], term, place[text], weight, len(vocabulary))

    def _hold(self, piece: np.ndarray, rest: np.ndarray, term: np.ndarray, doc: np.ndarray, weight: np.ndarray, words: int) -> None:
        self.piece, self.rest, self.n, self.doc, self.weight = piece, rest, len(piece), doc, weight
        # words ascend in the shard and in the vocabulary
        self.size = np.bincount(term, minlength=words)
        self.start = np.cumsum(self.size) - self.size
        some = self.size > 0
        self.most = np.zeros(words)
        if some.any():
            self.most[some] = np.maximum.reduceat(weight, self.start[some])

    def bounds(self, term: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What no score of each query exceeds; queries begin at `first` in `term`, none is empty."""
        return np.add.reduceat(self.most[term], first)

    def shrink(self, most: int) -> None:
        """Leaves the pieces of at most so many words, if these are less than half of the pieces."""
        fits = self.rest <= most
        if int(fits.sum()) * 2 >= self.n:
            return
        keep, place = fits[self.doc], (np.cumsum(fits) - 1).astype(np.int32)
        term = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)[keep]
        self._hold(self.piece[fits], self.rest[fits], term, place[self.doc[keep]], self.weight[keep], len(self.size))

    def scores(self, asked: list[np.ndarray]) -> np.ndarray:
        """(queries, pieces) scores of queries that are given by places in the vocabulary."""
        row, term = np.repeat(np.arange(len(asked), dtype=np.int32), [len(t) for t in asked]), np.concatenate(asked)
        # words of many queries and pieces are multiplied as matrices, some at a time; of the others postings are added up
        dense = np.bincount(term, minlength=len(self.size)) * self.size * DENSE > len(asked) * self.n
        full, place, words = dense[term], np.cumsum(dense) - 1, np.flatnonzero(dense)
        query = np.zeros((len(asked), len(words)), np.float32)
        query[row[full], place[term[full]]] = 1
        score = np.zeros((len(asked), self.n), np.float32)
        matrix = np.empty((min(len(words), ROWS), self.n), np.float32)
        for a in range(0, len(words), ROWS):
            own = words[a : a + ROWS]
            many = self.size[own]
            at = np.repeat(self.start[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            part = matrix[: len(own)]
            part[:] = 0
            part.reshape(-1)[np.repeat(np.arange(len(own)) * self.n, many) + self.doc[at]] = self.weight[at]
            score += query[:, a : a + ROWS] @ part
        some = ~full & (self.size[term] > 0)
        row, term = row[some], term[some]
        for a in range(0, len(asked), FEW):  # so few that their scores stay in the cache, each word's pieces together
            i, j = np.searchsorted(row, (a, a + FEW))
            by = np.argsort(term[i:j], kind="stable")
            t = term[i:j][by]
            many = self.size[t]
            total = int(many.sum())
            if total:
                at = np.repeat((self.start[t] - (np.cumsum(many) - many)).astype(np.int32), many) + np.arange(total, dtype=np.int32)
                key = np.repeat((row[i:j][by] - a) * np.int32(self.n), many) + self.doc[at]
                np.add.at(score[a : a + FEW].reshape(-1), key, self.weight[at])
        return score


@contextmanager
def _one_a_batch(spark: SparkSession) -> Iterator[None]:
    """While it lasts, rows go to Python one by one: a row is a whole shard."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _best(seed: np.ndarray, doc: np.ndarray, score: np.ndarray, key: np.ndarray, near: int) -> np.ndarray:
    """Which of some candidates are the `near` best of their seed, in order of seed, score and key."""
    rank = (seed.astype(np.int64) << 40) - score.astype(np.int64)
    order = np.argsort(rank)
    rank = rank[order]
    new = np.append(True, rank[1:] != rank[:-1])[: len(rank)]
    tied = np.flatnonzero(~(new & np.append(new[1:], True)[: len(rank)]))  # only these need their keys
    at = order[tied]
    order[tied] = at[np.lexsort((doc[at], key[at], rank[tied]))]
    s = seed[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    return order[np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s)))) < near]


def _index(slim: DataFrame, kind: T.DataType, shard_bytes: int) -> DataFrame:
    """A row for each shard: its texts' ids, their words, hashes and the postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        first, learnt, learn = [], 0, None
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def shard(*of: int):
            nonlocal part
            ids, keys, parts = zip(*(x for k in of for x in held.pop(k)))
            for k in of:
                del size[k]
            part += 1
            count, words, many, text, tf = _postings(parts)
            there = np.flatnonzero(count > 0)
            ids = pa.concat_arrays(ids).take(pa.array(there))
            place = np.full(len(count), -1, np.int32)
            place[there] = np.arange(len(there))
            key = np.concatenate(keys).view(np.uint64)[there]
            cols = {"key": key, "count": count[there], "words": words, "size": many, "text": place[text], "tf": tf}
            blobs = [pa.array([x.astype(_KINDS[k]).tobytes()], pa.binary()) for k, x in cols.items()]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *blobs], names=["shard", "ids", "key", *_COLUMNS])

        def add(ids: pa.Array, key: np.ndarray, counted: tuple[np.ndarray, ...], nbytes: int) -> Iterator[pa.RecordBatch]:
            count, word, text, tf = counted
            of = (_marked(len(count), word, text, learn[0]) @ learn[1].T).argmax(axis=1)
            for k in np.unique(of).tolist():
                there = np.flatnonzero(of == k)
                share = nbytes * int(count[there].sum()) // max(1, int(count.sum()))
                if k in held and (size[k] + share > shard_bytes or sum(len(x) for _, x, _ in held[k]) + len(there) > _MOST):
                    yield shard(k)
                place, own = np.cumsum(of == k, dtype=np.int32) - 1, of[text] == k
                held.setdefault(k, []).append((ids.take(pa.array(there)), key[there], (count[there], word[own], place[text[own]], tf[own])))
                size[k] = size.get(k, 0) + share
            while sum(size.values()) > 2 * shard_bytes:
                yield shard(max(size, key=size.get))

        def start() -> Iterator[pa.RecordBatch]:
            nonlocal first, learn
            learn = kinds([x[2] for x in first])
            for x in first:
                yield from add(*x)
            first = []

        for batch in batches:
            for piece in slices(batch, "text"):
                # words are counted slice by slice, and no text is held: copies, for a slice keeps the memory of its batch
                got = piece.column(0).take(pa.array(range(len(piece)), pa.int64())), piece.column(1).to_numpy().copy(), _counted(strings(piece.column(2))), piece.nbytes
                if learn:
                    yield from add(*got)
                    continue
                first.append(got)
                learnt += len(piece)
                if learnt >= LEARN or sum(x[3] for x in first) > shard_bytes // 2:
                    yield from start()
        if first:
            yield from start()
        small: list[int] = []
        for k in sorted(held, key=size.get):  # kinds of which there is little share a shard
            if small and (sum(size[x] for x in [*small, k]) > shard_bytes // 4 or sum(len(x) for i in [*small, k] for _, x, _ in held[i]) > _MOST):
                yield shard(*small)
                small = []
            small.append(k)
        if small:
            yield shard(*small)

    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(n, T.BinaryType()) for n in ("key", *_COLUMNS))])
    return shared_table(slim.mapInArrow(run, schema), "packing-index", **_GROUPS)


def _frequencies(index: DataFrame, shards: int) -> DataFrame:
    """Of each shard its words that two documents of the table or more have, sorted, and how many have them.

    Words move as arrays: of each shard those of one range of hashes are a row."""
    ranges = max(16, shards // 4)
    edges = (np.arange(1, ranges, dtype=np.float64) * 2.0**64 / ranges).astype(np.uint64)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, size = _blob(row, "words", "size")
                at = [0, *np.searchsorted(word, edges).tolist(), len(word)]
                spans = [(r, i, j) for r, (i, j) in enumerate(zip(at[:-1], at[1:])) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in spans], pa.int32()), pa.repeat(pa.scalar(row["shard"], pa.int64()), len(spans)), *(pa.array([x[i:j].tobytes() for _, i, j in spans], pa.binary()) for x in (word, size))], names=["range", "shard", "words", "size"])

    def add(table):
        rows = [(r["shard"], *_blob(r, "words", "size")) for r in table.to_pylist()]
        every, inverse = np.unique(np.concatenate([w for _, w, _ in rows]), return_inverse=True)
        df = np.bincount(inverse, weights=np.concatenate([n for _, _, n in rows])).astype(np.int64)[inverse]
        ends = np.cumsum([len(w) for _, w, _ in rows])
        own = [(s, w[d > 1], d[d > 1]) for (s, w, _), d in zip(rows, np.split(df, ends[:-1]))]
        return pa.table([table.column("range"), pa.array([s for s, _, _ in own], pa.int64()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in ([w for _, w, _ in own], [d for _, _, d in own]))], names=["range", "shard", "shared", "df"])

    def join(table):
        table = table.sort_by("range")
        return pa.table([table.column("shard").slice(0, 1), *(pa.array([b"".join(table.column(c).to_pylist())], pa.binary()) for c in ("shared", "df"))], names=["shard", "shared", "df"])

    counted = index.select("shard", "words", "size").mapInArrow(divide, "range int, shard bigint, words binary, size binary").groupBy("range").applyInArrow(add, "range int, shard bigint, shared binary, df binary")
    return shared_table(counted.groupBy("shard").applyInArrow(join, "shard bigint, shared binary, df binary"), "packing-frequencies")


def _queries(index: DataFrame, frequencies: DataFrame, n: int, number: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(seed, words, idf): the shared words of the documents that seed windows; `number` has their (places, seeds) by shard."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] not in number:
                    continue
                word, size, text = _blob(row, "words", "size", "text")
                places, seeds = number[row["shard"]]
                seed = np.full(_MOST + 1, -1, np.int64)
                seed[places] = seeds
                term = np.repeat(np.arange(len(word)), size)
                keep = seed[text] >= 0
                text, term = text[keep], term[keep]
                by = np.argsort(text, kind="stable")
                text, own = text[by], word[term[by]]
                at = np.flatnonzero(np.append(True, text[1:] != text[:-1])[: len(text)])
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (seed[text[at]], np.diff(np.append(at, len(text))), own))], names=["shard", "seeds", "sizes", "words"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seeds, sizes = (np.frombuffer(row[k], np.int64) for k in ("seeds", "sizes"))
                word, shared, df = _blob(row, "words", "shared", "df")
                if not len(shared):
                    continue
                i = np.minimum(np.searchsorted(shared, word), len(shared) - 1)
                keep = shared[i] == word
                ends = np.concatenate([[0], np.cumsum(keep)])[np.cumsum(sizes)].tolist()
                word, rarity = word[keep], idf(n, df[i[keep]]).astype(np.float32)
                spans = list(zip([0, *ends[:-1]], ends))
                yield pa.RecordBatch.from_arrays([pa.array(seeds), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (word, rarity))], names=["seed", "words", "idf"])

    few = F.col("shard").isin(list(number)) if len(number) <= FEW else F.lit(True)
    own, frequencies = index.where(few).select("shard", "words", "size", "text"), frequencies.where(few)
    own = own.mapInArrow(words, "shard bigint, seeds binary, sizes binary, words binary")
    return shared_table(own.join(frequencies, "shard").mapInArrow(weigh, "seed bigint, words binary, idf binary").where("length(words) > 0").sortWithinPartitions("seed"), "packing-queries", **_GROUPS)


def _gone(row: dict, begin: dict[int, int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a shard's pieces, and which of them are used."""
    number = np.frombuffer(row["doc"], np.int64) if row["doc"] is not None else begin[row["shard"]] + np.arange(len(row["count"]) // 8)
    return number, (bits[number >> 3] >> (7 - (number & 7)).astype(np.uint8) & 1).astype(bool)


def _left(pieces: DataFrame, begin: dict[int, int], used: np.ndarray, shard_bytes: int) -> DataFrame:
    """The shards of the pieces that are unused, those of like words in one."""
    bits, most = np.packbits(used), shard_bytes // 6
    groups = max(1, pieces.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (frequent words, how much of them, parts) for each kind

        def shard(parts: list) -> pa.RecordBatch:
            number, key, counted = zip(*parts)
            cols = dict(zip(_COLUMNS, _postings(counted)), doc=np.concatenate(number), key=np.concatenate(key))
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.array([cols[k].astype(_KINDS[k]).tobytes()], pa.binary()) for k in ("doc", "key", *_COLUMNS))], names=["shard", "doc", "key", *_COLUMNS])

        for row in _rows(batches):
            number, gone = _gone(row, begin, bits)
            count, words, size, text, tf, key = _blob(row, *_COLUMNS, "key")
            there = np.flatnonzero(~gone)
            if not len(there):
                continue
            place = np.full(len(count), -1, np.int32)
            place[there] = np.arange(len(there))
            text = place[text]
            keep = text >= 0
            many = np.add.reduceat(keep, np.cumsum(size) - size, dtype=np.int64)
            mark = np.sort(np.argsort(-many, kind="stable")[:MARKS])
            own, share = words[mark], many[mark] / np.linalg.norm(many[mark])
            parts = [(number[there], key[there], (count[there], np.repeat(words, size)[keep], text[keep], tf[keep]))]
            for k, (marks, shares, of) in enumerate(held):
                _, i, j = np.intersect1d(marks, own, assume_unique=True, return_indices=True)
                if shares[i] @ share[j] >= ALIKE:
                    if sum(int(x[0].sum()) for _, _, x in of + parts) <= most and sum(len(x) for x, _, _ in of + parts) <= _MOST:
                        of += parts
                    else:
                        held[k] = (own, share, parts)
                        yield shard(of)
                    break
            else:
                held.append((own, share, parts))
                if len(held) > KINDS:
                    yield shard(held.pop(0)[2])
        for _, _, of in held:
            yield shard(of)

    schema = ", ".join(["shard bigint", *(f"{n} binary" for n in ("doc", "key", *_COLUMNS))])
    with _one_a_batch(pieces.sparkSession):
        return shared_table(pieces.coalesce(groups).mapInArrow(run, schema), "packing-left", **_GROUPS)


def _asked(rows: list[pa.Table], order: np.ndarray) -> tuple[np.ndarray, ...]:
    """The vocabulary of some queries and its idf; their words as places in it, and where each query's begin. Takes the table out of its list."""
    table = rows.pop()
    found = [[np.frombuffer(table.column(c)[int(i)].as_buffer(), k) for i in order] for c, k in (("words", np.uint64), ("idf", np.float32))]
    begin = np.cumsum([0] + [len(x) for x in found[0]])[:-1]
    word, rarity = map(np.concatenate, found)
    del table, found
    pa.default_memory_pool().release_unused()  # before words are sorted, which needs memory itself
    vocabulary, first, inverse = np.unique(word, return_index=True, return_inverse=True)
    return vocabulary, rarity[first].astype(np.float64), inverse.astype(np.int32), begin


def _look_up(pieces: DataFrame, begin: dict[int, int], queries: tuple[np.ndarray, ...], room: np.ndarray, used: np.ndarray, mean: float, window: int, near: int) -> tuple[np.ndarray, ...]:
    """(query, piece, score) of the `near` best unused pieces that fit each query's room, in order of query and score."""
    vocabulary, every, term, first = queries
    bits = np.packbits(used)
    groups = max(1, pieces.sparkSession.sparkContext.defaultParallelism)
    names, forms = ["seed", "doc", "score", "key"], [np.int32, np.int64, np.float32, np.uint64]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.split(term, first[1:])
        least = np.zeros(len(asked), np.float32)
        got = [np.zeros(0, k) for k in forms]
        octave = np.frexp(room.astype(np.float64))[1]  # room < 2 ** octave
        for row in _rows(batches):
            count = np.frombuffer(row["count"], np.int64)
            number, gone = _gone(row, begin, bits)
            if gone.all():
                continue
            shard = Shard(row, gone, count % window, int(room.max()), vocabulary, every, mean)
            own = np.frombuffer(row["key"], np.uint64)
            found = [got]
            bound = shard.bounds(term, first)
            by = np.flatnonzero(bound >= np.maximum(least, 0.5))  # the others find nothing better here
            by = by[np.lexsort((-bound[by], -octave[by]))]  # the most room first, as a shard's pieces become fewer; queries of the shard's kind together
            for a in range(0, len(by), BATCH):
                q = by[a : a + BATCH]
                shard.shrink(1 << int(octave[q[0]]))
                if not shard.n:
                    break
                score = shard.scores([asked[k] for k in q.tolist()])
                hit = score >= np.maximum(least[q], 0.5)[:, None]
                hit &= shard.rest <= room[q, None]
                for r in np.flatnonzero(np.count_nonzero(hit, axis=1) > 2 * near).tolist():
                    own_hits = score[r, hit[r]]
                    hit[r] &= score[r] >= np.partition(own_hits, len(own_hits) - near)[len(own_hits) - near]
                r, j = np.divmod(np.flatnonzero(hit), shard.n)
                found.append([q[r].astype(np.int32), number[shard.piece[j]], score[r, j], own[shard.piece[j]]])
            del shard
            got = [np.concatenate(x) for x in zip(*found)]
            best = _best(*got, near)
            got = [x[best] for x in got]
            last = np.flatnonzero(np.bincount(got[0], minlength=len(asked)) == near)
            least[last] = got[2][np.searchsorted(got[0], last, "right") - 1]
        yield from blobs(got)

    def blobs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A row for each group of seeds: single candidates as rows would cost more than to find them."""
        for g in np.unique(cols[0] % groups).tolist():
            own = cols[0] % groups == g
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *(pa.array([x[own].astype(k).tobytes()], pa.binary()) for x, k in zip(cols, forms))], names=["part", *names])

    def read(table: pa.Table) -> list[np.ndarray]:
        return [np.concatenate([np.zeros(0, k), *(np.frombuffer(x.as_buffer(), k) for x in table.column(n))]) for n, k in zip(names, forms)]

    def merge(table: pa.Table) -> pa.Table:
        cols = read(table)
        best = _best(*cols, near)
        return pa.Table.from_batches(blobs([x[best] for x in cols]))

    schema = ", ".join(["part int", *(f"{n} binary" for n in names)])
    with _one_a_batch(pieces.sparkSession):
        own = pieces.coalesce(groups).mapInArrow(run, schema)
        seed, doc, score, tie = read(own.groupBy("part").applyInArrow(merge, schema).toArrow())
    best = _best(seed, doc, score, tie, near)
    return seed[best], doc[best], score[best]


def choose_seeds(rest: np.ndarray, key: np.ndarray, used: np.ndarray, window: int) -> np.ndarray:
    """The unused pieces that seed windows: those of more than half a window, and the ones of smallest key that the words need besides; the most room first."""
    left = np.flatnonzero(~used)
    need = -(-int(rest[left].sum()) // window)
    large = rest[left] * 2 > window
    chosen = left[np.lexsort((left, key[left], ~large))[: max(need, int(large.sum()))]]
    return chosen[np.lexsort((chosen, key[chosen], rest[chosen]))]


def pack_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seeds: int = SEEDS, near: int = NEAR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each piece of a document: (window, place, id, first_word, n_words, score); the seed has place 0 and no score."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    collect_garbage(spark)  # what ran before may have left large heaps
    slim = spread(slim.where("text is not null"))
    cores = max(1, spark.sparkContext.defaultParallelism)
    # a task that sees more text has fewer shards that aren't full
    index = _index(slim.coalesce(max(2 * cores, slim.rdd.getNumPartitions() // 3)), kind, shard_bytes)
    sizes = sorted((r["shard"], *_blob(r, "count", "key")) for r in index.select("shard", "count", "key").toArrow().to_pylist())
    begin = {s: int(b) for (s, _, _), b in zip(sizes, np.cumsum([0] + [len(c) for _, c, _ in sizes]))}
    count = np.concatenate([np.zeros(0, np.int64), *(c for _, c, _ in sizes)])
    key = np.concatenate([np.zeros(0, np.uint64), *(k for _, _, k in sizes)])
    with _one_a_batch(spark):
        frequencies = _frequencies(index, len(sizes))
    n, mean = len(count), max(float(count.mean()), 1e-9) if len(count) else 1.0
    rest = count % window
    used = rest == 0
    path = f"{shared_folder(spark)}/packing-windows-{uuid.uuid4().hex}.parquet"
    out = [*(array("q") for _ in range(5)), array("d")]

    def add(*row) -> None:
        for c, x in zip(out, row):
            c.append(x)

    def write(least: int) -> None:
        if len(out[0]) >= least:
            cols = [np.array(c) for c in out]  # a seed's score is no number
            made = pa.table([*map(pa.array, cols[:5]), pa.array(cols[5], mask=np.isnan(cols[5]))], names=["window", "place", "doc", "first_word", "n_words", "score"])
            spark.createDataFrame(made).coalesce(1).write.mode("append").parquet(path)
            for c in out:
                del c[:]

    number = looked = 0
    for doc in np.lexsort((np.arange(n), key))[: n if (count >= window).any() else 0]:
        for a in range(0, int(count[doc] - rest[doc]), window):
            add(number, 0, int(doc), a, window, np.nan)
            number += 1
        write(1_000_000)
    collect_garbage(spark)
    starts = np.array(list(begin.values()), np.int64)
    shards = list(begin)
    pieces, held = index.select("shard", F.lit(None).cast("binary").alias("doc"), "key", *_COLUMNS), n
    while not used.all():
        seed = choose_seeds(rest, key, used, window)
        used[seed] = True
        room, place = window - rest[seed], np.ones(len(seed), np.int64)
        for c, x in zip(out, (np.arange(number, number + len(seed)), np.zeros(len(seed), np.int64), seed, (count - rest)[seed], rest[seed], np.full(len(seed), np.nan))):
            c.frombytes(x.tobytes())
        open_ = np.ones(len(seed), bool)
        asking = None
        while not used.all():
            open_ &= room >= rest[~used].min()
            if not open_.any():
                break
            if asking is None:
                own = np.searchsorted(starts, seed, "right") - 1
                with _one_a_batch(spark):
                    asking = _queries(index, frequencies, n, {shards[k]: (seed[own == k] - starts[k], np.flatnonzero(own == k)) for k in np.unique(own).tolist()})
            todo = np.flatnonzero(open_)
            for a in range(0, len(todo), seeds):
                some = todo[a : a + seeds]
                some = some[room[some] >= rest[~used].min()] if not used.all() else some[:0]
                if not len(some):
                    break
                unused = n - int(used.sum())
                if unused * 2 <= held > SMALL:  # so that a look-up doesn't read what is packed
                    pieces, held = _left(pieces, begin, used, shard_bytes), unused
                rows = asking.where(F.col("seed").between(int(some[0]), int(some[-1]))).toArrow()
                at = rows.column("seed").to_numpy()
                order = np.argsort(at)
                order = order[np.isin(at[order], some)]
                open_[np.setdiff1d(some, at)] = False  # no word of theirs is shared
                some = at[order]
                if not len(some):
                    continue
                rows = [rows]
                del at  # a view of their memory
                queries = _asked(rows, order)
                query, doc, score = _look_up(pieces, begin, queries, room[some], used, mean, window, near)
                del queries
                # plans, broadcasts and checkpoints of a look-up stay on both sides of the driver until its garbage is collected
                looked += 1
                collect_garbage(spark, executors=looked % EVERY == 0)
                edge = np.searchsorted(query, np.arange(len(some) + 1)).tolist()
                for q, s in enumerate(some.tolist()):
                    i, j = edge[q], edge[q + 1]
                    left = int(room[s])
                    for k in (i + np.flatnonzero(~used[doc[i:j]])).tolist():
                        d = int(doc[k])
                        if rest[d] <= left:
                            used[d] = True
                            add(number + s, int(place[s]), d, int(count[d] - rest[d]), int(rest[d]), float(score[k]) / GRAIN)
                            left -= int(rest[d])
                            place[s] += 1
                    room[s] = left
                    if j - i < near:  # that was all there is for this window
                        open_[s] = False
                write(1_000_000)
        number += len(seed)
    write(0)
    ids = index.select("shard", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(spark.createDataFrame(list(begin.items()), "shard bigint, begin bigint")), "shard")
    ids = ids.select((F.col("begin") + F.col("pos")).alias("doc"), "id")
    return spark.read.parquet(path).join(ids, "doc").select("window", "place", F.col("id").alias(id_col), "first_word", "n_words", "score")
