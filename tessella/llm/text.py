"""Vectorised text primitives shared by the corpus operators.

Everything here works on whole Arrow string arrays: the UTF-8 buffer of a batch is
viewed as one numpy byte vector, so no Python loop runs over documents or words.
Nulls count as empty texts.  A word is a maximal run of ASCII letters, ASCII digits
and bytes of non-ASCII characters, after lower-casing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes (a longer text is a slice of its own).
CHUNK_BYTES = 2 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

WORD = np.zeros(256, dtype=bool)
for _c in range(256):
    WORD[_c] = _c >= 0x80 or chr(_c).isalnum()

_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=_U)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 23:
            _tables[name] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def strings(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array in which nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pc.fill_null(col, "")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a `strings` array, and the len + 1 offsets into them."""
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(offs):
        offs = np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces whose texts come to about `most` bytes."""
    i = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        base = at[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(at, base + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def span_hash(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of `b`, which may be of any unsigned type; spans are sorted and don't overlap."""
    if len(b) <= CHUNK_BYTES * 4:
        return mix(_polynomial(b, start, end))
    h = np.empty(len(start), dtype=_U)
    step, i = CHUNK_BYTES * 2, 0
    while i < len(h):  # powers restart in every piece: tables stay small however long one text is
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + step, "right")))
        h[i:j] = _polynomial(b[base : end[j - 1]], start[i:j] - base, end[i:j] - base)
        i = j
    return mix(h)


def _polynomial(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(b) + 1, dtype=_U)
    np.cumsum((b.astype(_U) + _U(1)) * _powers("p", _P, len(b) + 1)[: len(b)], out=sums[1:])
    return (sums[end] - sums[start]) * _powers("q", _PINV, len(b) + 1)[start]


class Words:
    """The words of some texts: 64-bit hashes, byte spans and the texts they are in."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        if lower:
            texts = pc.utf8_lower(texts)
        self.bytes, self.offsets = buffers(texts)
        n, b = len(texts), self.bytes
        isw = WORD[b]
        start = isw.copy()
        start[1:] &= ~isw[:-1]
        first = self.offsets[:-1][np.diff(self.offsets) > 0]
        start[first] = isw[first]
        end = isw.copy()
        end[:-1] &= ~isw[1:]
        end[first[1:] - 1] = isw[first[1:] - 1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        at = np.searchsorted(self.start, self.offsets)
        #: Words of text i are those from first[i] up to first[i + 1].
        self.first = at
        self.count = np.diff(at)
        self.text = np.repeat(np.arange(n, dtype=np.int64), self.count)
        self.hash = span_hash(b, self.start, self.end)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n words, and the texts they are in; a text of fewer words is one run."""
        h, text, size = self.hash, self.text, len(self.hash)
        if not size:
            return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
        acc = np.zeros(size, dtype=_U)
        for k in range(n):
            acc[: size - k] += h[k:] * _U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        whole = np.zeros(size, dtype=bool)
        last = self.first[1:][self.count > 0]
        for k in range(1, n):
            gone = last - k
            whole[gone[gone >= 0]] = True
        short = (self.count > 0) & (self.count < n)
        keep = ~whole
        # texts of fewer than n words: the one run is summed from their own words only
        for t in np.flatnonzero(short):
            i = self.first[t]
            acc[i] = sum(int(h[i + k]) * pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(self.count[t])) % (1 << 64)
            keep[i : i + self.count[t]] = False
            keep[i] = True
        return mix(acc[keep]), text[keep]


def segment_starts(text: np.ndarray, n_texts: int) -> np.ndarray:
    """For sorted text numbers, the n_texts + 1 places where each text's rows begin."""
    return np.searchsorted(text, np.arange(n_texts + 1))
