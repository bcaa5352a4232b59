"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (1 to 3 letters, each word padded
with one blank on either side) of a language in order of rank.  A document's own
most frequent n-grams are ranked in the same way; its out-of-place distance to a
language is the sum over its n-grams of how far the two ranks lie apart, an n-gram
that the profile lacks counting as `TOP` places.  Divided by the most that the sum
could be, the distance lies in 0 to 1; the nearest language wins, ties by name.

Profiles are fitted on labelled rows, at most `ROWS_PER_LANGUAGE` of each language
(those of the smallest hashed ids); identification reads every text whole.

A text is rejected where it is farther from every language than `MAX_DISTANCE` plus
`MARGIN` divided by the square root of the number of its n-grams: its distance is a mean
over these, so it strays the more the fewer they are.

Cases: a null or empty text, and one without letters, has no language (null), the
distance 1 and is rejected; ties of frequency go to the n-gram of smaller code; with
an empty table, or without labelled rows, every text stays unidentified; repeated
rows are identified each on their own; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.partitioning import spread
from .text import CHUNK_BYTES, slices, strings

#: Places in a profile, of a language or a document.
TOP = 300
#: Labelled rows of each language that its profile is fitted on, at most.
ROWS_PER_LANGUAGE = 400
#: Rows drawn for each of them before the smallest hashes are taken.
OVERSAMPLE = 4
#: Languages up to which their sampling bounds are broadcast; more of them are joined by a shuffle, with the same result.
FEW_LANGUAGES = 100_000
#: Distance at which a text of many n-grams is rejected, and what is added for one n-gram, falling with the square root of their number.
MAX_DISTANCE, MARGIN = 0.62, 0.5

_BITS = 21  # of a code point
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each run of other characters than letters made one blank (0), with one blank at
    either end of a text; and the text that each is in."""
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    text = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    letter = _is_letter()[raw]
    codes = np.where(letter, raw, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[1:] |= text[1:] != text[:-1]
    keep[:1] = True
    # a text that begins with a letter has no blank before it: one is put there
    first = np.ones(len(text), bool)
    first[1:] = text[1:] != text[:-1]
    front = np.flatnonzero(first & letter)
    codes, text, keep = (np.insert(x, front, y) for x, y in ((codes, 0), (text, text[front]), (keep, True)))
    return codes[keep], text[keep]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Sorted packed (text, gram) numbers, how often each occurs, the bits of a letter in them, and the letters' code points.

    A gram packs three letter numbers, the first one highest: 0 for none, 1 for a blank, then the slice's letters in order of
    code point, so that grams sort as their code points do."""
    codes, text = _codes(texts)
    present = np.zeros(0x110000, bool)
    present[codes] = True
    present[0] = True
    alphabet = np.flatnonzero(present)
    bits = int(len(alphabet) + 1).bit_length()
    number = np.zeros(int(alphabet[-1]) + 1, np.uint64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    if 3 * bits + int(len(texts) - 1).bit_length() > 64:
        raise OverflowError
    x, b = number[codes], np.uint64(bits)
    own = text.astype(np.uint64) << np.uint64(3 * bits)
    own |= x << np.uint64(2 * bits)
    letters = x > 1
    same = text[1:] == text[:-1]
    two = own[:-1] | (x[1:] << b)
    parts = [own[letters], two[same & (letters[1:] | letters[:-1])]]
    if len(x) > 2:
        parts.append((two[:-1] | x[2:])[same[1:] & same[:-1] & letters[1:-1]])
    keys = np.sort(np.concatenate(parts))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))), bits, alphabet


def _wide(gram: np.ndarray, bits: int, alphabet: np.ndarray) -> np.ndarray:
    """The same grams with 21 bits a letter, as profiles have them: code points, 1 for a blank, 0 for none."""
    point = np.concatenate([[0, 1], alphabet[1:]]).astype(np.uint64)
    mask, b = np.uint64((1 << bits) - 1), np.uint64(bits)
    return (point[(gram >> (b + b)) & mask] << np.uint64(2 * _BITS)) | (point[(gram >> b) & mask] << np.uint64(_BITS)) | point[gram & mask]


def _halves(f, texts: list[str], *args):
    half = len(texts) // 2
    a, b = f(texts[:half], *args), f(texts[half:], *args)
    return (np.append(a[0], b[0] + half), *(np.append(x, y) for x, y in zip(a[1:], b[1:])))


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count), sorted by text and gram."""
    try:
        key, count, bits, alphabet = _grams(texts)
    except OverflowError:
        return _halves(_counts, texts)
    mask = np.uint64((1 << 3 * bits) - 1)
    return (key >> np.uint64(3 * bits)).astype(np.int64), _wide(key & mask, bits, alphabet), count


def _top(texts: list[str], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, rank from 0) of the `top` most frequent grams of each text."""
    try:
        key, count, bits, alphabet = _grams(texts)
        most = int(count.max()) if len(count) else 0
        wide = most.bit_length()
        if 3 * bits + wide + int(len(texts) - 1).bit_length() > 64:
            raise OverflowError
    except OverflowError:
        if len(texts) > 1:
            return _halves(_top, texts, top)
        doc, gram, count = _counts(texts)
        order = np.lexsort((gram, -count))[:top]
        return doc[order], gram[order], np.arange(len(order))
    g = np.uint64(3 * bits)
    mask = np.uint64((1 << 3 * bits) - 1)
    doc = key >> g
    order = np.sort((((doc << np.uint64(wide)) | (most - count).astype(np.uint64)) << g) | (key & mask))
    doc = (order >> np.uint64(3 * bits + wide)).astype(np.int64)
    rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(texts)))[doc]
    keep = rank < top
    return doc[keep], _wide(order[keep] & mask, bits, alphabet), rank[keep]


def profile(texts: list[str], top: int = TOP) -> np.ndarray:
    """The grams of one profile in order of rank, counted over all the texts together."""
    total: dict[int, int] = {}
    for i in range(0, len(texts), 256):
        _, gram, count = _counts(texts[i : i + 256])
        uniq, inv = np.unique(gram, return_inverse=True)
        for g, c in zip(uniq.tolist(), np.bincount(inv, weights=count).astype(np.int64).tolist()):
            total[g] = total.get(g, 0) + c
    return np.array([g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:top]], dtype=np.uint64)


def distances(texts: list[str], profiles: list[np.ndarray], top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Per text and profile the distance, 0 to 1; per text the number of n-grams compared."""
    n = len(texts)
    doc, gram, rank = _top(texts, top)
    size = np.bincount(doc, minlength=n)
    every = np.unique(np.concatenate(profiles)) if profiles else np.zeros(0, np.uint64)
    out = np.ones((n, len(profiles)))
    if not len(doc) or not len(every):
        return out, size
    i = np.minimum(np.searchsorted(every, gram), len(every) - 1)
    known = every[i] == gram
    doc_k, rank_k, i = doc[known], rank[known], i[known]
    for j, p in enumerate(profiles):
        place = np.full(len(every), -1, np.int64)
        place[np.searchsorted(every, p)] = np.arange(len(p))
        there = place[i]
        gap = np.where(there < 0, top, np.minimum(np.abs(there - rank_k), top))
        total = np.bincount(doc_k, weights=gap, minlength=n) + top * (size - np.bincount(doc_k, minlength=n))
        out[:, j] = np.where(size > 0, total / np.maximum(size * top, 1), 1.0)
    return out, size


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE, top: int = TOP) -> list[tuple[str, list[int]]]:
    """Profiles of the languages of `labelled`, each from at most `rows_per_language` rows, fitted one language to a task.

    Rows are drawn by hash, about `OVERSAMPLE` times as many as wanted, before any text moves; of these the smallest hashes stay.
    What comes back is as many numbers as `top` for each language, whatever the table's size."""
    slim = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    share = F.least(F.lit(1.0), F.lit(float(OVERSAMPLE * rows_per_language)) / F.col("n"))
    below = slim.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (share * 2.0**64 - 2.0**63).alias("below"))
    # a row for each language: broadcast where these are as few as they should be, so that only sampled texts move
    few = below.count() <= FEW_LANGUAGES
    sample = slim.join(F.broadcast(below) if few else below, "lang").where("h <= below").select("lang", "h", "i", "text")

    def one(key, table):
        table = table.sort_by([("h", "ascending"), ("i", "ascending"), ("text", "ascending")]).slice(0, rows_per_language)
        grams = profile(pc.utf8_lower(strings(table.column("text"))).to_pylist(), top)
        return pa.table({"lang": [key[0].as_py()], "grams": pa.array([grams.astype(np.int64).tolist()], pa.list_(pa.int64()))})

    fitted = sample.groupBy("lang").applyInArrow(one, "lang string, grams array<bigint>")
    return sorted((r.lang, list(r.grams)) for r in fitted.collect())


def _judge(part: pa.RecordBatch, at: int, names: list[str], profiles: list[np.ndarray], max_distance: float):
    texts = pc.utf8_lower(strings(part.column(at))).to_pylist()
    dist, size = distances(texts, profiles)
    if not profiles:
        dist = np.ones((len(texts), 1))
    best = dist.argmin(axis=1)
    near = dist[np.arange(len(texts)), best]
    known = (size > 0) & bool(profiles)
    keep = known & (near <= max_distance + MARGIN / np.sqrt(np.maximum(size, 1)))
    lang = [names[b] if k else None for b, k in zip(best.tolist(), known.tolist())]
    return lang, near, keep


def identify(docs: DataFrame, fitted: list[tuple[str, list[int]]], id_col: str = "doc_id", text_col: str = "text", max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(id, language, distance, keep) of every row."""
    names, profiles = [n for n, _ in fitted], [np.array(g, dtype=np.int64).astype(np.uint64) for _, g in fitted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES // 2):
                lang, near, keep = _judge(part, 1, names, profiles, max_distance)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(near), pa.array(keep)], names=[id_col, "language", "distance", "keep"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("language", T.StringType()), T.StructField("distance", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, fitted: list[tuple[str, list[int]]], text_col: str = "text", max_distance: float = MAX_DISTANCE) -> DataFrame:
    """The rows whose language is identified, with all their columns."""
    names, profiles = [n for n, _ in fitted], [np.array(g, dtype=np.int64).astype(np.uint64) for _, g in fitted]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, CHUNK_BYTES // 2):
                keep = _judge(part, at, names, profiles, max_distance)[2]
                if keep.any():
                    yield part if keep.all() else part.filter(pa.array(keep))

    return spread(docs).mapInArrow(run, docs.schema)
