"""Quality rules by suffix array: how much of a text repeats earlier or later parts of it.

Per text, the suffixes (in words) are sorted by prefix doubling; the longest common
prefixes of neighbours in that order delimit the maximal repeated substrings.  The
spans of those of at least `MIN_WORDS` words are united; the rules limit the fraction
of the text's words that they cover, and the words of the longest repeat.

Suffixes whose first `MIN_WORDS` words occur once in the text can't begin such a
repeat, so only the others, and those their comparisons reach, enter the sort.

Cases: a null or empty text, or one without words, has 0 words and is rejected by
`min_words`; a null id passes through; repeated rows are judged each on their own;
further columns are ignored.  Whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.partitioning import spread
from .text import Words, slices, strings

#: Repeats of fewer words count as ordinary language; a power of two.
MIN_WORDS = 8
#: A text passes with at most this fraction of its words in repeats ...
MAX_COVERED = 0.5
#: ... a longest repeat of at most this many words ...
MAX_LONGEST = 100
#: ... and at least this many words.
LEAST_WORDS = 1


def repeats(w: Words, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words covered by repeated substrings of `least` words or more, and the longest of these."""
    n_texts = len(w.count)
    covered, longest = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    n = len(w.hash)
    at, lcp = _longest(w, least)
    if not len(at):
        return covered, longest
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + lcp, -1)
    inside = np.cumsum(edge[:-1]) > 0
    np.add.at(covered, w.text[inside], 1)
    np.maximum.at(longest, w.text[at], lcp)
    return covered, longest


def _longest(w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that begin a repeat, and for each the longest prefix that occurs elsewhere in its text."""
    h, text, n = w.hash, w.text, len(w.hash)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= least:
        return none
    end = np.repeat(w.first[1:], w.count)  # where the text of each word ends
    acc = np.zeros(n, np.uint64)
    for k in range(least):
        acc[: n - k] += h[k:] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    acc += text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = np.flatnonzero(np.arange(n) + least <= end)
    grams = acc[whole]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return none
    twice = np.unique(twice)
    where = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
    active = whole[twice[where] == grams]
    # the suffixes to sort: those, and the ones that begin where their first words end
    inside = np.zeros(n + least, bool)
    inside[active] = True
    reach = active + least
    inside[reach[reach < end[active]]] = True
    pos = np.flatnonzero(inside)
    padded = np.append(h, np.zeros(least, np.uint64))
    keys = []
    for k in range(least - 1, -1, -1):
        word = padded[pos + k]
        word[pos + k >= end[pos]] = 0
        keys.append(word)
    keys.append(text[pos].astype(np.uint64))
    order = np.lexsort(keys)
    new = np.zeros(len(pos), bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    rank = np.full(n + 1, -1, np.int64)  # of each suffix by its first k words; -1 past the text
    rank[pos[order]] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, k = [rank], least
    pos = pos[order]
    while True:
        r = levels[-1][pos]
        same = np.zeros(len(pos), bool)
        same[1:] = r[1:] == r[:-1]
        tied = same.copy()
        tied[:-1] |= same[1:]
        if not tied.any():
            break
        t = np.flatnonzero(tied)
        p = pos[t]
        ahead = p + k
        second = np.where(ahead < end[p], levels[-1][np.minimum(ahead, n)], -1)
        sub = np.lexsort((second, r[t]))
        pos[t] = p[sub]
        second, first = second[sub], r[t][sub]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = levels[-1].copy()
        rank[pos[t]] = t[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        levels.append(rank)
        k *= 2
    # longest common prefixes of neighbours, from the ranks at every level and the last few words
    a, b = pos[:-1], pos[1:]
    lcp = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = (x < end[a]) & (y < end[b])
        eq = ok & (levels[j][np.minimum(x, n)] == levels[j][np.minimum(y, n)]) & (levels[j][np.minimum(x, n)] >= 0)
        lcp[eq] += least << j
    for _ in range(least - 1):
        x, y = a + lcp, b + lcp
        ok = (x < end[a]) & (y < end[b]) & (text[a] == text[b]) & (lcp >= least)
        eq = ok & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])
        lcp[eq] += 1
    best = np.zeros(len(pos), np.int64)
    best[:-1] = lcp
    best[1:] = np.maximum(best[1:], lcp)
    hit = best >= least
    return pos[hit], best[hit]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_words, covered_words, longest_repeat) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(strings(part.column(1)))
                covered, longest = repeats(w, min_words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.count.astype(np.int64)), pa.array(covered), pa.array(longest)], names=[id_col, "n_words", "covered_words", "longest_repeat"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_words", "covered_words", "longest_repeat")])
    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)


def judge(measured: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds covered_fraction and keep to what `measure` gives."""
    fraction = F.when(F.col("n_words") > 0, F.col("covered_words") / F.col("n_words")).otherwise(F.lit(0.0))
    return measured.withColumn("covered_fraction", fraction).withColumn(
        "keep", (F.col("n_words") >= least_words) & (F.col("covered_fraction") <= max_covered) & (F.col("longest_repeat") <= max_longest)
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, **limits) -> DataFrame:
    """One row for each document: its repetition figures, and whether the rules keep it."""
    return judge(measure(docs, id_col, text_col, min_words), **limits)


def keep_quality(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows that the rules keep, with all their columns, decided in one pass without a join."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                w = Words(strings(part.column(at)))
                covered, longest = repeats(w, min_words)
                good = (w.count >= least_words) & (covered <= max_covered * w.count) & (longest <= max_longest)
                if good.any():
                    yield part if good.all() else part.filter(pa.array(good))

    return spread(docs).mapInArrow(run, docs.schema)
