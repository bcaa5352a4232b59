"""Edit-aware token counts.

A text's pre-tokens (the pieces that a byte-level BPE encodes on their own) are the
leaves of a segment tree whose nodes hold sums of characters and of tokens. An edit
descends by characters to the pre-tokens it touches, re-reads from the last pre-token
that could not see the edit until old and new pre-token borders meet again, re-encodes
what lies between, and updates the sums on the way up. The rest is never looked at.

Where a pre-token ends depends on its own text and on at most `CONTEXT` characters after
it, and on nothing before its start: that is the boundary context.

Trees last: `leaf_table` gives a table's leaves, and `edit_leaves` takes them, a batch of
edits at a time, and gives them again; it reads edited documents only and counts nothing
that an edit didn't touch.

Counting a whole table reads pre-token borders off character classes, a slice at a time,
and encodes each distinct pre-token of a slice once.

Cases: null and empty texts have no pre-tokens and 0 tokens; edits of them insert; an
edit's place is cut to the text's end, an edit with a null in it does nothing; edits of a
document apply one after the other in order of `seq`; edits of unknown documents are
dropped; repeated rows get the same edits each; an empty table gives no rows; further
columns are ignored; whole texts are counted, however long.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.partitioning import spread
from .text import slices, span_hash, strings

#: Characters past its end that may decide where a pre-token ends.
CONTEXT = 2
#: Pre-tokens in a leaf block of a tree; a block of more than twice as many is split.
BLOCK = 64
#: Counts of pre-tokens that a worker keeps.
CACHE = 600_000

_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WS = "".join(map(chr, _SPACES))
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[_SPACES] = SPACE
    return table


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(_PATTERN)


def borders(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: a flag for each code point. `begin` flags the first one of each text."""
    c = _classes()[codes]
    n = len(c)
    start = begin.copy()
    start[1:] |= c[1:] != c[:-1]
    space = c == SPACE
    follows = np.zeros(n, bool)  # a character other than a space follows in the same text
    follows[:-1] = ~space[1:] & ~begin[1:]
    last = space & follows
    start |= last
    joined = np.flatnonzero(last & (codes == 32)) + 1
    start[joined] = False
    # contractions: an apostrophe that begins a pre-token, and one or two letters
    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        wide = np.concatenate([codes, [0, 0]])
        flag = np.concatenate([begin, [True, True, True]])
        a, b = wide[quote + 1], wide[quote + 2]
        in1, in2 = ~flag[quote + 1], ~flag[quote + 1] & ~flag[quote + 2]
        one = in1 & np.isin(a, [ord(x) for x in "stmd"])
        two = in2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        start[quote[one | two] + 1] = False
        for where, more in ((quote[one], 2), (quote[two & ~one], 3)):
            at = where + more
            at = at[at < n]
            # the letters that follow begin a pre-token of their own; any other class begins one already, but for a joined blank's
            start[at[c[at] == LETTER]] = True
    return start


class Counter:
    """Token counts of pre-tokens under a byte-level BPE vocabulary (a file of base64 tokens and ranks)."""

    def __init__(self, rank_file: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = {t for t in ranks}
        self.bpe = tiktoken.Encoding("counts", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[int, int] = {}

    def one(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        return 1 if raw in self.whole else len(self.bpe._encode_single_piece(raw))

    def leaves(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters and tokens of all pre-tokens, and the len + 1 places at which the texts' pre-tokens begin."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(size)])
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.zeros(len(codes), bool)
        begin[at[:-1][size > 0]] = True
        start = np.flatnonzero(borders(codes, begin)) if len(codes) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(codes))
        uniq, first, inverse = np.unique(span_hash(codes, start, end), return_index=True, return_inverse=True)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        counts = []
        for h, s, e in zip(uniq.tolist(), start[first].tolist(), end[first].tolist()):
            k = cache.get(h)
            if k is None:
                k = cache[h] = self.one(joined[s:e])
            counts.append(k)
        return end - start, np.array(counts, np.int64)[inverse], np.searchsorted(start, at)


@lru_cache(maxsize=2)
def counter(rank_file: str) -> Counter:
    return Counter(rank_file)


class Tree:
    """Segment tree over blocks of the pre-tokens of one text."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], count):
        self.text, self.count = text, count
        self._build([chars[i : i + BLOCK] for i in range(0, len(chars), BLOCK)] or [[]], [tokens[i : i + BLOCK] for i in range(0, len(tokens), BLOCK)] or [[]])

    def _build(self, chars: list[list[int]], tokens: list[list[int]]) -> None:
        self.chars, self.tokens = chars, tokens
        self.width = 1
        while self.width < len(chars):
            self.width *= 2
        self.sum_chars, self.sum_tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i in range(len(chars)):
            self.sum_chars[self.width + i], self.sum_tokens[self.width + i] = sum(chars[i]), sum(tokens[i])
        for i in range(self.width - 1, 0, -1):
            self.sum_chars[i] = self.sum_chars[2 * i] + self.sum_chars[2 * i + 1]
            self.sum_tokens[i] = self.sum_tokens[2 * i] + self.sum_tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sum_tokens[1]

    def _find(self, char: int) -> tuple[int, int, int]:
        """(block, place in it, first character) of the pre-token that holds a character; of the last one past the end."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if before + self.sum_chars[node] <= char and self.sum_chars[node + 1]:
                before += self.sum_chars[node]
                node += 1
        block, place = node - self.width, 0
        sizes = self.chars[block]
        while place < len(sizes) - 1 and before + sizes[place] <= char:
            before += sizes[place]
            place += 1
        return block, place, before

    def edit(self, at: int, gone: int, new: str) -> int:
        """Replaces `gone` characters from `at` by `new`; the number of pre-tokens that were encoded for it."""
        old_len = len(self.text)
        at = max(0, min(at, old_len))
        gone = max(0, min(gone, old_len - at))
        if not gone and not new:
            return 0
        # from the first pre-token that the edit could change: one that ends CONTEXT characters before it could not
        block, place, begin = self._find(max(0, at - CONTEXT))
        shift = len(new) - gone
        text = self.text[:at] + new + self.text[at + gone :]
        find = _pattern().match
        made_chars: list[int] = []
        made_tokens: list[int] = []
        pos, (b, p, old) = begin, (block, place, begin)
        done = at + len(new)
        while pos < len(text):
            if pos >= done:  # do an old border and this one agree?
                while b < len(self.chars) and old < pos - shift:
                    if p < len(self.chars[b]):
                        old += self.chars[b][p]
                        p += 1
                    else:
                        b, p = b + 1, 0
                if old == pos - shift and b < len(self.chars):
                    break
            end = find(text, pos).end()
            made_chars.append(end - pos)
            made_tokens.append(self.count(text[pos:end]))
            pos = end
        else:
            b, p = len(self.chars) - 1, len(self.chars[-1])
        self.text = text
        self._replace(block, place, b, p, made_chars, made_tokens)
        return len(made_chars)

    def _replace(self, block: int, place: int, b: int, p: int, chars: list[int], tokens: list[int]) -> None:
        """Puts leaves in place of those from (block, place) up to (b, p)."""
        new_chars = self.chars[block][:place] + chars + self.chars[b][p:]
        new_tokens = self.tokens[block][:place] + tokens + self.tokens[b][p:]
        if len(new_chars) > 2 * BLOCK or (not new_chars and len(self.chars) > 1):
            cut = range(0, len(new_chars), BLOCK)
            self._build(self.chars[:block] + [new_chars[i : i + BLOCK] for i in cut] + self.chars[b + 1 :] or [[]], self.tokens[:block] + [new_tokens[i : i + BLOCK] for i in cut] + self.tokens[b + 1 :] or [[]])
            return
        for i in range(block, b + 1):
            self.chars[i], self.tokens[i] = (new_chars, new_tokens) if i == block else ([], [])
            node = self.width + i
            self.sum_chars[node], self.sum_tokens[node] = sum(self.chars[i]), sum(self.tokens[i])
            node //= 2
            while node:
                self.sum_chars[node] = self.sum_chars[2 * node] + self.sum_chars[2 * node + 1]
                self.sum_tokens[node] = self.sum_tokens[2 * node] + self.sum_tokens[2 * node + 1]
                node //= 2


EDITS = T.ArrayType(T.StructType([T.StructField("seq", T.LongType()), T.StructField("at", T.LongType()), T.StructField("gone", T.LongType()), T.StructField("new", T.StringType())]))


def count_edited(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(id, n_pretokens, n_tokens, n_edits, n_reencoded, n_tokens_edited) of every row.

    `edits_col` has the row's edits, an array of (seq, at, gone, new): put `new` in place of `gone` characters from `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(rank_file)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = strings(part.column(1)).to_pylist()
                chars, tokens, at = c.leaves(texts)
                rows = []
                for k, edits in enumerate(part.column(2).to_pylist()):
                    i, j = int(at[k]), int(at[k + 1])
                    total = int(tokens[i:j].sum())
                    todo = [e for e in edits or () if e and None not in e.values()]
                    redone, after = 0, total
                    if todo:
                        tree = Tree(texts[k], chars[i:j].tolist(), tokens[i:j].tolist(), c.one)
                        for e in sorted(todo, key=lambda e: e["seq"]):
                            redone += tree.edit(e["at"], e["gone"], e["new"])
                        after = tree.total
                    rows.append((j - i, total, len(todo), redone, after))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in cols)], names=[id_col, *names])

    names = ["n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_edited"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in names])
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), F.col(edits_col).cast(EDITS).alias("edits"))
    return spread(slim).mapInArrow(run, schema)


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """The documents, with the edits of a table (id, seq, at, gone, new) that are theirs as an array, in place of a column of that name."""
    docs = docs.drop(edits_col)
    key = _fresh(docs, "edited_id")
    own = edits.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(key)).agg(F.collect_list(F.struct("seq", "at", "gone", "new")).alias(edits_col))
    return docs.join(own, docs[id_col] == F.col(key), "left").drop(key)


_LEAVES = [T.StructField("text", T.StringType()), T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))]


def leaf_table(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, chars, tokens): the leaves of every row's tree, characters and tokens of its pre-tokens in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(rank_file)
        for batch in batches:
            for part in slices(batch, "text"):
                chars, tokens, at = c.leaves(strings(part.column(1)).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (chars, tokens)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=[id_col, "text", "chars", "tokens"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return spread(slim).mapInArrow(run, T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *_LEAVES]))


def edit_leaves(leaves: DataFrame, edits: DataFrame, rank_file: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text, chars, tokens, n_tokens, n_reencoded) of the edited rows of a `leaf_table`, after the edits (id, seq, at, gone, new).

    Rows without edits aren't in the result: theirs stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(rank_file)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for r in part.to_pylist():
                    tree, redone = Tree(r["text"] or "", r["chars"] or [], r["tokens"] or [], c.one), 0
                    for e in sorted((e for e in r["edits"] if None not in e.values()), key=lambda e: e["seq"]):
                        redone += tree.edit(e["at"], e["gone"], e["new"])
                    rows.append((tree.text if redone or tree.text or r["text"] is not None else None, [x for b in tree.chars for x in b], [x for b in tree.tokens for x in b], tree.total, redone))
                cols = list(zip(*rows))
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds))], names=[id_col, "text", "chars", "tokens", "n_tokens", "n_reencoded"])

    edited = with_edits(leaves.select(id_col, "text", "chars", "tokens"), edits, id_col).where("edits is not null").withColumn("edits", F.col("edits").cast(EDITS))
    schema = T.StructType([T.StructField(id_col, leaves.schema[id_col].dataType), *_LEAVES, T.StructField("n_tokens", T.LongType()), T.StructField("n_reencoded", T.LongType())])
    return edited.mapInArrow(run, schema)


def sample_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with three edits each, which their id and length decide: words swapped in, put in and taken out."""
    n = F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1))
    place = lambda salt: F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), n.cast("bigint"))
    edit = lambda seq, gone, new: F.struct(F.lit(seq).cast("bigint").alias("seq"), place(seq).alias("at"), F.lit(gone).cast("bigint").alias("gone"), F.lit(new).alias("new"))
    return docs.select(F.col(id_col), F.col(text_col), F.array(edit(1, 12, " it's 2024,  revised"), edit(2, 0, "\n\nnew line"), edit(3, 7, "")).alias("edits"))
