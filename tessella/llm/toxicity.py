"""Toxicity by a factorization machine over hashed terms.

A document's features are its distinct words, hashed; its score is
    w0 + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2),
so that pairs of words (an insult and the mention of a group, say) have weights of
their own that additive models lack, at a cost in proportion to the words. A document
is toxic where the logistic of its score exceeds `CUTOFF`.

Terms are hashed to 2^`HASH_BITS` buckets, which share weights: that bounds the machine,
and a lasso, which leaves at zero the weights that no slope keeps away from it. No term is
left out beforehand, for one that tells nothing on its own may tell much beside another.
Linear weights are fitted first, then the pairs to what these leave, by Adam on the log
loss, `BATCH` rows a step, on at most `FIT_ROWS` labelled rows: those of the smallest
hashed ids. `DAMPING` keeps the steps of rare terms small. Every `HELD_OUT`th row is held
out to place the cut: the bias is moved so that `CUTOFF` is where the F-measure on these
rows is best. Scoring reads every text whole.

Cases: a null or empty text scores w0 alone, ties are rows of equal words and score alike;
texts count whole, however long; null ids pass through; repeated rows are scored each on
their own; where labels repeat an id the largest counts, where documents do the text of
smallest hash; unlabelled rows are scored and never fitted on; without labels of both
kinds every text scores the share of toxic labels (0 without any); further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.partitioning import spread
from .text import Words, slices, strings

#: Labelled rows that are fitted on, at most.
FIT_ROWS = 12_000
#: Latent factors of a bucket, passes over the rows, rows of a step, and the penalties on the size of linear weights, in standard errors of their slopes, and of the factors of a bucket together.
FACTORS, EPOCHS, BATCH, LASSO_LINEAR, LASSO_FACTORS = 4, 40, 2048, 3.0, 4e-3
#: First step of Adam, which falls to nothing, and what is added to the root mean square of a weight's slopes before they are divided by it.
STEP, DAMPING = 0.05, 1e-2
CUTOFF = 0.5
#: Of so many rows one isn't fitted on, but places the cut.
HELD_OUT = 5
#: Terms are hashed to so many bits.
HASH_BITS = 18


class Machine:
    """w0, w and v: bias, linear weights and factors by bucket."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w.astype(np.float32), v.astype(np.float32)

    def scores(self, w: Words) -> np.ndarray:
        """Probability that each text is toxic."""
        n = len(w.count)
        total = np.full(n, self.w0)
        text, term = features(w)
        if len(text):
            total += np.bincount(text, weights=self.w[term], minlength=n)
            at = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            v = self.v[term]
            sums = np.add.reduceat(v, at, axis=0).astype(np.float64)
            squares = np.add.reduceat((v * v).sum(axis=1), at)
            total[text[at]] += 0.5 * ((sums**2).sum(axis=1) - squares)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs in order of text."""
    key = np.unique((w.text << HASH_BITS) | (w.hash >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    return key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)


def train(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, lasso: tuple[float, float] = (LASSO_LINEAR, LASSO_FACTORS), batch: int = BATCH, seed: int = 7) -> Machine:
    """Fits a machine to the distinct buckets of each row, and places its cut by those held out."""
    rows, labels = list(rows), np.asarray(labels, np.float64)
    order = np.random.default_rng(seed).permutation(len(rows))
    held, fitted = order[::HELD_OUT], np.delete(order, np.s_[::HELD_OUT])
    if len({*labels[held].tolist()}) < 2 or len({*labels[fitted].tolist()}) < 2:
        return _fit(rows, labels, factors, epochs, lasso, batch, seed)
    machine = _fit([rows[k] for k in fitted], labels[fitted], factors, epochs, lasso, batch, seed)
    score = np.array([machine.w0 + machine.w[r].sum() + 0.5 * float((machine.v[r].sum(axis=0) ** 2).sum() - (machine.v[r] ** 2).sum()) for r in (rows[k] for k in held)])
    by = np.argsort(-score, kind="stable")
    found, falls = np.cumsum(labels[held][by]), np.append(score[by][1:] < score[by][:-1], True)
    best = int(np.argmax(np.where(falls, 2 * found / (np.arange(1, len(by) + 1) + found[-1]), -1)))
    machine.w0 -= float(score[by][best : best + 2].mean())
    return machine


def _fit(rows: list[np.ndarray], labels: np.ndarray, factors: int, epochs: int, lasso: tuple[float, float], batch: int, seed: int) -> Machine:
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Machine(float(np.clip(np.log(max(share, 1e-13) / max(1 - share, 1e-13)), -30, 30)), np.zeros(1 << HASH_BITS), np.zeros((1 << HASH_BITS, factors)))
    rng = np.random.default_rng(seed)
    seen, every = np.unique(np.concatenate(rows), return_inverse=True)
    ends = np.cumsum([len(r) for r in rows])
    rows = np.split(every.astype(np.int32), ends[:-1])
    m = len(seen)
    # what the slope of a bucket's linear weight strays by where the bucket tells nothing, as many times as `lasso` has it
    spread = (lasso[0] * np.sqrt(np.bincount(every) * share * (1 - share)) / len(ends)).astype(np.float32)
    # columns: the linear weight, then the factors
    x = np.concatenate([np.zeros((m, 1)), rng.normal(0, 0.05, (m, factors))], axis=1).astype(np.float32)
    a, b = np.zeros_like(x), np.zeros_like(x)
    w0, a0, b0, step = float(np.log(share / (1 - share))), 0.0, 0.0, 0
    batch = max(1, min(batch, -(-len(rows) // 16)))
    steps = epochs * -(-len(rows) // batch)
    for epoch in range(epochs):
        pairs = epoch >= epochs // 2  # factors are fitted to what the linear weights leave
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            some = order[i : i + batch]
            size = np.array([len(rows[k]) for k in some])
            term, row = np.concatenate([rows[k] for k in some]), np.repeat(np.arange(len(some)), size)
            there = size > 0
            at = (np.cumsum(size) - size)[there]
            vx = x[term]
            sums = np.zeros((len(some), factors + 1), np.float32)
            squares = np.zeros(len(some), np.float32)
            if len(term):
                sums[there] = np.add.reduceat(vx, at, axis=0)
            if len(term) and pairs:
                squares[there] = np.add.reduceat((vx[:, 1:] ** 2).sum(axis=1), at)
            score = w0 + sums[:, 0] + pairs * 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
            gap = ((1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some]) / len(some)).astype(np.float32)
            slope = np.zeros_like(x)
            own = gap[row]
            slope[:, 0] += np.bincount(term, weights=own, minlength=m)
            for f in range(1, (factors if pairs else 0) + 1):
                slope[:, f] += np.bincount(term, weights=own * (sums[row, f] - vx[:, f]), minlength=m)
            step += 1
            a += 0.1 * (slope - a)
            b += 0.01 * (np.square(slope) - b)
            rate = STEP * max(0.0, 1 - step / steps) / (np.sqrt(b / (1 - 0.99**step)) + DAMPING)
            x -= rate * (a / (1 - 0.9**step))
            g = float(gap.sum())
            a0, b0 = a0 + 0.1 * (g - a0), b0 + 0.01 * (g * g - b0)
            w0 -= STEP * max(0.0, 1 - step / steps) * (a0 / (1 - 0.9**step)) / ((b0 / (1 - 0.99**step)) ** 0.5 + DAMPING)
            # weights that their slopes don't keep away from zero are zero, the factors of a bucket together
            x[:, 0] = np.sign(x[:, 0]) * np.maximum(np.abs(x[:, 0]) - rate[:, 0] * spread, 0)
            if not pairs:
                continue
            v = x[:, 1:]
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v *= np.maximum(1 - rate[:, 1:].mean(axis=1, keepdims=True) * lasso[1] / np.maximum(norm, 1e-12), 0)
    w, v = np.zeros(1 << HASH_BITS, np.float32), np.zeros((1 << HASH_BITS, factors), np.float32)
    w[seen], v[seen] = x[:, 0], x[:, 1:]
    return Machine(w0, w, v)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Machine:
    """A machine fitted to at most `fit_rows` labelled documents."""
    chosen = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, h = features(Words(strings(part.column(1))))
                at = np.searchsorted(text, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([h[i:j].astype(np.int32).tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], names=["id", "label", "h", "terms"])

    # `chosen` has a bounded number of two-number rows: it may be broadcast at any size of the table
    joined = texts.join(F.broadcast(chosen), "id").select("id", "text", "label", F.xxhash64("text").alias("h"))
    got = joined.mapInArrow(terms, "id bigint, label int, h bigint, terms binary").groupBy("id", "label").agg(F.min_by("terms", F.struct("h", "terms")).alias("terms")).toArrow().sort_by("id")
    return train([np.frombuffer(t.as_py(), np.int32) for t in got.column("terms")], got.column("label").to_numpy())


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(id, score, toxic) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = machine.scores(Words(strings(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p > cutoff)], names=[id_col, "score", "toxic"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)
