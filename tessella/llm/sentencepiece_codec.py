"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For each prefix of a segment the table keeps the one token that the prefix's encoding
ends with. An Aho-Corasick automaton over the vocabulary yields the pieces that end at a
place; of these the right one is the piece that is an encoding of its own and may follow
the last token of what is before it. Two tokens may follow each other unless undoing
their merges, the later one first, meets a pair that would have merged before. The ids
are then read off backwards. Characters outside the vocabulary become byte tokens.

No piece holds a blank after another character, so a text falls into segments (a run of
blanks and what follows it up to the next one; a line break on its own), which are
encoded independently; equal segments of a slice are encoded once, and a worker keeps
those met before, `CACHE` at most. Segments that begin with several blanks are merged
step by step, since pieces of several blanks have equal scores.

Cases: a null text gives null ids, an empty one none; U+2581 counts as a blank, as the
library has it; null ids pass through; repeated rows are encoded each on their own; whole
texts are encoded, however long; ties of score go to the leftmost pair; an empty table
gives no rows; further columns are ignored. A model that normalises, or whose pieces hold
blanks elsewhere, is refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.partitioning import spread
from .text import buffers, slices, span_hash, strings

BLANK = "▁"
#: Encoded segments that a worker keeps.
CACHE = 600_000


class Codec:
    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in normal}
        self.score = [sp.get_score(i) for i in range(n)]
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        #: Bytes that an id decodes to, with blanks.
        self.raw = [b""] * n
        for piece, i in self.id_of.items():
            self.raw[i] = piece.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_id):
            self.raw[i] = bytes([b])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array([len(r) for r in self.raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_size)[:-1]])
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        #: The last merge of each piece that is the encoding of itself; None for single characters; other pieces are missing.
        self.split: dict[int, tuple[int, int] | None] = {}
        for piece, i in self.id_of.items():
            made = self._merge(piece)
            if made[0] == [i]:
                self.split[i] = made[1]
        self.fits: dict[int, bool] = {}
        self.cache: dict[int, tuple[int, ...]] = {}
        self._check(sp)

    def _check(self, sp) -> None:
        """Refuses a model that splits, normalises or marks beginnings otherwise than is assumed here."""
        if any(BLANK in p.lstrip(BLANK) for p in self.id_of):
            raise ValueError("a piece holds a blank after another character")
        probe = ["", "a", " a", "a ", "  a  b ", "A\uff21 \ufb01 e\u0301 \u00e9", "\tx\n y", "\u65e5\u672c\u8a9e", "\U0001f600", "the end of it"]
        ids, at = self.encode(pa.array(probe, pa.large_string()))
        for k, text in enumerate(probe):
            if [int(i) for i in ids[at[k] : at[k + 1]]] != list(sp.encode(text)):
                raise ValueError(f"the model encodes {text!r} otherwise than by merging it as it stands")

    def _merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Ids by merging step by step, the best score first and the leftmost of equal ones; and the last pair that merged."""
        sym: list[str | None] = list(text)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(sym):
                i = self.id_of.get(sym[a] + sym[b])
                if i is not None:
                    heapq.heappush(heap, (-self.score[i], a, b, i, sym[a] + sym[b]))

        for a in range(len(sym) - 1):
            offer(a, a + 1)
        last = None
        while heap:
            _, a, b, i, made = heapq.heappop(heap)
            if sym[a] is None or sym[b] is None or nxt[a] != b or sym[a] + sym[b] != made:
                continue
            last = (self.id_of.get(sym[a], -1), self.id_of.get(sym[b], -1))
            sym[a], sym[b] = made, None
            nxt[a] = nxt[b]
            if nxt[a] < len(sym):
                prv[nxt[a]] = a
            offer(prv[a], a)
            offer(a, nxt[a])
        out: list[int] = []
        for s in sym:
            if s is not None:
                i = self.id_of.get(s)
                out.extend([i] if i is not None else (self.byte_id[x] for x in s.encode("utf-8", "surrogatepass")))
        return out, last

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' text is the two tokens."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._may_follow(a, b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        piece, score, split, id_of = self.piece, self.score, self.split, self.id_of
        left, right = a, b
        limit, equal = None, False  # a merge across happens first if it scores above the limit (or equals it, where it is further left)
        while True:
            across = id_of.get(piece[left] + piece[right])
            if across is not None:
                s = score[across]
                if limit is None or s > limit or (equal and s == limit):
                    return False
            sl, sr = split[left], split[right]
            if sl is None and sr is None:
                return True
            # undo the later of both merges: the one of lower score, the right one of equal ones
            if sr is None or (sl is not None and score[left] < score[right]):
                limit, equal, left = score[left], False, sl[1]
            else:
                limit, equal, right = score[right], True, sr[0]

    def segment(self, text: str) -> tuple[int, ...]:
        """Ids of one segment, blanks written as U+2581."""
        if text.startswith(BLANK + BLANK):
            return tuple(self._merge(text)[0])
        n = len(text)
        token: list[int] = [-2] * (n + 1)
        token[0] = -1
        size = [0] * (n + 1)
        split, fits = self.split, self.fits
        done = 0
        for end, (i, length) in self.automaton.iter(text):
            end += 1
            if end > done + 1:  # places that no piece ends at: characters outside the vocabulary
                for at in range(done + 1, end):
                    if token[at] == -2:
                        token[at], size[at] = -1, 1
            done = max(done, end - 1)
            if token[end] != -2 or i not in split:
                continue
            before = token[end - length]
            if before == -2:
                continue
            if before != -1:
                key = before << 20 | i
                ok = fits.get(key)
                if ok is None:
                    ok = self.may_follow(before, i)
                if not ok:
                    continue
            token[end], size[end] = i, length
        for at in range(done + 1, n + 1):
            if token[at] == -2:
                token[at], size[at] = -1, 1
        out: list[int] = []
        at = n
        while at:
            if token[at] >= 0:
                out.append(token[at])
            else:
                out.extend(self.byte_id[x] for x in reversed(text[at - 1].encode("utf-8", "surrogatepass")))
            at -= size[at]
        return tuple(reversed(out))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the len + 1 places at which the texts' ids begin. The texts are a `strings` array."""
        texts = pc.replace_substring(texts, BLANK, " ")
        n = len(texts)
        # the library puts one blank before a text
        none, lead = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        b, off = buffers(pc.if_else(pc.equal(pc.binary_length(texts), 0), none, pc.binary_join_element_wise(none, texts, lead)))
        if not len(b):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        blank, line = b == 32, b == 10
        start = line.copy()
        start[1:] |= (blank[1:] & ~blank[:-1]) | line[:-1]
        start[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(start)
        end = np.append(start[1:], len(b))
        h = span_hash(b, start, end)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        raw, cache, ids = b.tobytes(), self.cache, []
        if len(cache) > CACHE:
            cache.clear()
        for k, s, e in zip(uniq.tolist(), start[first].tolist(), end[first].tolist()):
            got = cache.get(k)
            if got is None:
                got = cache[k] = self.segment(raw[s:e].decode("utf-8", "surrogatepass").replace(" ", BLANK))
            ids.append(got)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for t in ids for x in t), np.int32, int(size.sum()))
        at = np.cumsum(size) - size
        sizes = size[inverse]
        place = np.concatenate([[0], np.cumsum(sizes)])
        out = flat[np.repeat(at[inverse] - place[:-1], sizes) + np.arange(int(place[-1]))]
        begins = np.searchsorted(start, off)
        return out, place[begins]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row, and the len + 1 places at which the texts begin; the leading blank is taken off."""
        size = self.raw_size[ids]
        place = np.concatenate([[0], np.cumsum(size)])
        b = self.raw_bytes[np.repeat(self.raw_at[ids] - place[:-1], size) + np.arange(int(place[-1]))]
        begins = place[at]
        some = np.diff(begins) > 0
        keep = np.ones(len(b), bool)
        keep[begins[:-1][some]] = b[begins[:-1][some]] != 32
        gone = np.concatenate([[0], np.cumsum(~keep)])
        return b[keep], begins - gone[begins]


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = c.encode(strings(part.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=part.column(1).is_null())
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row; null for null ids. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            col = pc.fill_null(batch.column(1), pa.scalar([], pa.list_(pa.int32())))
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy(zero_copy_only=False))]).astype(np.int64)
            b, begins = c.decode(col.flatten().to_numpy(zero_copy_only=False), at)
            raw = b.tobytes()
            texts = [None if gone else raw[i:j].decode("utf-8", "replace") for gone, i, j in zip(batch.column(1).is_null().to_pylist(), begins[:-1].tolist(), begins[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(F.col(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_ids, exact): the ids of every row, and whether decoding them gives the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = strings(part.column(1))
                ids, at = c.encode(texts)
                got, begins = c.decode(ids, at)
                had, off = buffers(texts)
                size = np.diff(begins)
                exact = size == np.diff(off)
                if exact.all():
                    differ = np.concatenate([[0], np.cumsum(got != had)])
                    exact &= np.diff(differ[off]) == 0
                else:
                    for i in np.flatnonzero(exact):
                        exact[i] = np.array_equal(got[begins[i] : begins[i + 1]], had[off[i] : off[i + 1]])
                null = part.column(1).is_null()
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=null)
                count = pa.array(np.diff(at), pa.int64(), mask=null.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, count, pa.array(exact, mask=null.to_numpy(zero_copy_only=False))], names=[id_col, "ids", "n_ids", "exact"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("exact", T.BooleanType())])
    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, schema)
