"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. Every text gets a signature of `PERMUTATIONS` minima over its word `SHINGLE`-grams and
   a 128-bit fingerprint of its word sequence; texts with equal words are one from here on.
2. Signatures are cut into `BANDS` bands; texts that agree in a band share a bucket. In each
   bucket the smallest id is the pivot, paired with all others: as many pairs as rows.
3. Sequential verification: a pair's signatures are compared `STEP` hashes at a time; it is
   dropped as soon as the posterior probability (uniform prior) that its similarity reaches
   the threshold falls below `MISS`. Survivors are verified exactly on their shingle sets.
4. Verified pairs make connected components (alternating large-star and small-star steps).
5. Where a bucket still holds several components: if it has at most `EXACT` rows, all pairs
   across them go through step 3. The documents of larger ones are joined exactly: two sets of
   shingles of similarity t share one of the first n - ceil(t n) + 1 shingles of each, in any
   order that is the same for all. The order puts the frequent ones last (by a count of about
   2^`SLOTS` classes of hashes), so that boilerplate brings few documents together. Pairs that
   such a shingle shows are left out only where what follows it is too short to reach t,
   and verified on their shingle sets without step 3.
   No bucket, group or partner list is capped.

What is missed: pairs that agree in no band (at similarity 0.6 one in 80, at 0.7 one in
6,000) unless both are in buckets of more than `EXACT` rows, and those dropped in step 3.

Signatures and texts of candidates alone are moved: a Bloom filter of the wanted ids (of at most
2^`FILTER_BITS` bits; beyond that it lets more through) goes to the scan.

Result: a row (id, group_id) for each member of a group of two or more, group_id being the
group's smallest id.

Cases: null or wordless texts belong to no group; rows with a null id are left out; rows
that repeat an id count as one document with the words of smallest fingerprint; equal
texts are one group; a text of fewer words than a shingle is one shingle; whole texts
count, however long; an empty table has no groups; further columns, also ones named like
those made here, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.partitioning import spread
from .lineage import cut
from .text import Words, mix, segment_starts, slices, strings

#: Words in a shingle, minima in a signature, and the bands these are cut into.
SHINGLE, PERMUTATIONS, BANDS = 3, 128, 32
#: Jaccard similarity of shingle sets from which two texts are near-duplicates.
THRESHOLD = 0.6
#: Chance at which a true pair may be dropped at each look, and hashes between looks.
MISS, STEP = 0.005, 16
#: Rows up to which all pairs across the components of a bucket are compared, and bits of a Bloom filter at most.
EXACT, FILTER_BITS = 64, 26
#: Bits of a shingle's hash by which its frequency is counted, and of these the ones that are added up together.
SLOTS, TOGETHER = 20, 14

_A = (mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, PERMUTATIONS) minima; a text without shingles has the largest numbers."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(starts) - 1, PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    for i in range(len(starts) - 1):
        for a in range(int(starts[i]), int(starts[i + 1]), 1024):
            part = x[a : min(a + 1024, int(starts[i + 1])), None] ^ _B
            part *= _A
            np.minimum(out[i], part.min(axis=0), out=out[i])
    return out


def least_matches(threshold: float = THRESHOLD, miss: float = MISS, step: int = STEP, total: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """(hashes seen, matches needed): under a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1),
    whose tail above t is the chance of at most m successes in n + 1 trials of chance t."""
    out = []
    for n in range(step, total + 1, step):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def prints(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit fingerprint of the word sequence of each text, in two halves."""
    place = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.first[:-1], w.count).astype(np.uint64)
    some = np.flatnonzero(w.count > 0)
    halves = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        p = np.zeros(len(w.count), np.uint64)
        if len(some):
            p[some] = np.add.reduceat(mix(w.hash ^ (place * np.uint64(salt))), w.first[:-1][some])
        halves.append(p.view(np.int64))
    return halves[0], halves[1]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(strings(part.column(1)))
            shingles, text = w.shingles(SHINGLE)
            sig = signatures(shingles, segment_starts(text, len(part)))
            rows = pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, prints(w)), pa.array([s.tobytes() for s in sig], pa.binary())], names=["id", "p1", "p2", "sig"])
            yield rows.filter(pa.array(w.count > 0))


def _with_prints(column: int, names: tuple[str, str]):
    """Adds the fingerprint of the text in a column, null where it has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[column]):
                w = Words(strings(part.column(column)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(p, mask=w.count == 0) for p in prints(w))], names=[*part.schema.names, *names])

    return run


def _prune(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    looks = least_matches()
    for batch in pairs:
        if not len(batch):
            continue
        a, b = (np.stack([np.frombuffer(s, np.uint32) for s in batch.column(i).to_pylist()]) for i in (2, 3))
        alive, seen, at = np.arange(len(batch)), np.zeros(len(batch), np.int64), 0
        for n, need in looks:
            if n > a.shape[1]:
                break
            seen[alive] += (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
            alive, at = alive[seen[alive] >= need], n
        yield batch.select([0, 1]).take(pa.array(alive))


def jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact similarity of the shingle sets of texts in the same place of both columns; 0 where neither has a shingle."""
    sides, sizes, n = [], [], len(a)
    for col in (a, b):
        s, t = Words(strings(col)).shingles(SHINGLE)
        order = np.lexsort((s, t))
        s, t = s[order], t[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        sides.append((s[new], t[new]))
        sizes.append(np.bincount(t[new], minlength=n))
    s, t = (np.concatenate(x) for x in zip(*sides))
    order = np.lexsort((s, t))
    s, t = s[order], t[order]
    both = np.bincount(t[1:][(s[1:] == s[:-1]) & (t[1:] == t[:-1])], minlength=n)
    return both / np.maximum(sizes[0] + sizes[1] - both, 1)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "y", 1 << 20):
                for again in slices(part, "x", 1 << 20):
                    good = jaccard(again.column(2), again.column(3)) >= threshold
                    yield again.select([0, 1]).filter(pa.array(good))

    return run


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOTS)).astype(np.int64)


def _crowds(texts: DataFrame) -> np.ndarray:
    """How many shingles of the texts are in each of 2^SLOTS classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                at, many = np.unique(_slot(Words(strings(part.column(1))).shingles(SHINGLE)[0]), return_counts=True)
                n[at] += many
        if n.any():
            rows = [x.tobytes() for x in n.reshape(-1, 1 << TOGETHER)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["part", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table.column("n").to_pylist()], axis=0)
        return pa.table([table.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "n"])

    cores = texts.sparkSession.sparkContext.defaultParallelism
    out = np.zeros((1 << SLOTS - TOGETHER, 1 << TOGETHER), np.int64)
    for row in texts.coalesce(max(1, cores)).mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").toArrow().to_pylist():
        out[row["part"]] = np.frombuffer(row["n"], np.int64)
    return out.reshape(-1)


def _prefixes(crowd: np.ndarray, threshold: float):
    """Of each text its id, how many shingles it has, and the first of them, the frequent ones last: texts of this similarity share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s, t = Words(strings(part.column(1))).shingles(SHINGLE)
                order = np.lexsort((s, crowd[_slot(s)], t))
                s, t = s[order], t[order]
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
                s, t = s[new], t[new]
                n = np.bincount(t, minlength=len(part))
                place = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
                first = n - np.ceil(threshold * n - 1e-6).astype(np.int64) + 1
                keep = place < first[t]
                ends = np.concatenate([[0], np.cumsum(np.bincount(t[keep], minlength=len(part)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(s[keep].view(np.int64)))], names=["id", "n", "first"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in `edges` (u, v): root is the smallest id that is connected to it.

    Alternating large-star and small-star steps; ids are sent to smaller ones until nothing changes."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = cut(linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now, before = (e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for e in (after, edges))
        edges = after
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def _sifted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ids are wanted, and few others, found without moving any."""
    bits = 1 << min(FILTER_BITS, max(6, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = wanted.select(place.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    # one row of at most 2^FILTER_BITS bits
    one = rows.sparkSession.createDataFrame(pa.table({"filter": pa.array([table], pa.list_(pa.int64()))}))
    return rows.join(F.broadcast(one), F.expr(f"getbit(filter[cast(pmod(xxhash64(id), {bits}) div 64 as int)], cast(pmod(xxhash64(id), {bits}) % 64 as int)) = 1"), "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, exact: int = EXACT, compared: list | None = None) -> DataFrame:
    """(id, group_id) of the members of all groups of near-duplicates; `compared` gets the number of pairs of each round."""
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    signed = cut(spread(texts).mapInArrow(_sign, "id bigint, p1 bigint, p2 bigint, sig binary"))
    twice = signed.groupBy("id").agg(F.min(F.struct("p1", "p2")).alias("least"), F.count("*").alias("n")).where("n > 1")
    repeated = not twice.isEmpty()
    if repeated:
        signed = cut(signed.join(twice, "id", "left").where("n is null or p1 = least.p1 and p2 = least.p2").select("id", "p1", "p2", "sig").dropDuplicates(["id"]))
    copies = signed.groupBy("p1", "p2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = cut(signed.select("id", "p1", "p2").join(copies, ["p1", "p2"]).select("id", "rep"))
    gone = same.where("id <> rep").select("id").distinct()
    bands = signed.join(gone, "id", "left_anti")
    width = PERMUTATIONS // BANDS * 4
    band_key = lambda k: F.xxhash64(F.lit(k), F.expr(f"substring(sig, {k * width + 1}, {width})"))
    bucket = Window.partitionBy("band")

    def ids(pairs: DataFrame) -> DataFrame:
        return cut(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())

    def looked(pairs: DataFrame, sig: DataFrame) -> DataFrame:
        a, b = sig.select(F.col("id").alias("u"), F.col("sig").alias("a")), sig.select(F.col("id").alias("v"), F.col("sig").alias("b"))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_prune, "u bigint, v bigint")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(id, text) of the wanted ids, and few others; one row an id."""
        held = _sifted(texts, wanted)
        if repeated:
            held = held.mapInArrow(_with_prints(1, ("p1", "p2")), "id bigint, text string, p1 bigint, p2 bigint").join(signed.select("id", "p1", "p2"), ["id", "p1", "p2"], "left_semi").select("id", "text").dropDuplicates(["id"])
        return held

    def exactly(pairs: DataFrame) -> DataFrame:
        held = cut(texts_of(ids(pairs)))
        x, y = (held.select(F.col("id").alias(i), F.col("text").alias(t)) for i, t in (("u", "x"), ("v", "y")))
        return cut(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_verify(threshold), "u bigint, v bigint"))

    def verified(pairs: DataFrame) -> DataFrame:
        if compared is not None:
            compared.append(pairs.count())
        # the first look takes one batch of hashes, and drops most; the rest of a signature moves for what is left
        first = signed.select("id", F.expr(f"substring(sig, 1, {STEP * 4})").alias("sig"))
        likely = cut(looked(pairs, first))
        pruned = cut(looked(likely, _sifted(signed.select("id", "sig"), ids(likely))))
        return exactly(pruned)

    def joined(members: DataFrame) -> DataFrame:
        """The pairs (u, v) of members (id, root) of different roots whose similarity reaches the threshold, all of them."""
        held = texts_of(members.select("id"))
        first = held.mapInArrow(_prefixes(_crowds(held), threshold), "id bigint, n int, first array<bigint>").join(members, "id").select("id", "root", "n", F.posexplode("first").alias("place", "s"))
        of = Window.partitionBy("s")
        shared = cut(first.select("*", F.min("root").over(of).alias("low"), F.max("root").over(of).alias("high")).where("low < high").drop("low", "high"))
        a, b = (shared.select("s", *(F.col(c).alias(c + side) for c in ("id", "root", "n", "place"))) for side in "ab")
        # what follows the first shingle that both have bounds what they share
        enough = F.expr(f"ida < idb and roota <> rootb and least(na - placea, nb - placeb) >= {threshold / (1 + threshold)!r}D * (na + nb) - 1e-6D")
        pairs = cut(a.join(b, "s").where(enough).select(F.col("ida").alias("u"), F.col("idb").alias("v")).distinct())
        if compared is not None:
            compared.append(pairs.count())
        return exactly(pairs)

    rows = bands.select("id", F.explode(F.array(*[band_key(k) for k in range(BANDS)])).alias("band")).select("band", "id")
    rows = cut(rows.select("*", F.min("id").over(bucket).alias("pivot"), F.max("id").over(bucket).alias("most")).where("pivot < most").drop("most"))
    stars = cut(rows.where("id <> pivot").select(F.col("pivot").alias("u"), F.col("id").alias("v")).distinct())
    found = verified(stars)
    linked = components(found)
    of = rows.join(linked, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    of = of.select("*", F.count("*").over(bucket).alias("n"), F.min("root").over(bucket).alias("low"), F.max("root").over(bucket).alias("high"))
    mixed = cut(of.where("low < high").drop("low", "high"))
    few, many = mixed.where(F.col("n") <= exact), cut(mixed.where(F.col("n") > exact).select("id", "root").distinct())
    left, right = few.select("band", F.col("id").alias("u"), F.col("root").alias("ru")), few.select("band", F.col("id").alias("v"), F.col("root").alias("rv"))
    across = cut(left.join(right, "band").where("u < v and ru <> rv").select("u", "v").distinct().join(stars, ["u", "v"], "left_anti"))
    if not across.isEmpty():
        found = found.unionByName(verified(across))
    if not many.isEmpty():
        found = found.unionByName(joined(many))
    copied = same.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    whole = components(found.unionByName(copied))
    return whole.select(F.col("id").cast(kind).alias(id_col), F.col("root").cast(kind).alias("group_id"))


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each group left, the one of smallest id; all columns stay.

    Rows that repeat an id are one document: one row of it stays, that of smallest fingerprint (null and wordless texts last;
    ties by text, then by all columns). Rows with a null id all stay."""
    groups = near_duplicates(docs, id_col, text_col, threshold)
    loser, n, p1, p2, place = (_fresh(docs, c) for c in ("loser", "n", "p1", "p2", "place"))
    losers = groups.where(F.col(id_col) != F.col("group_id")).select(F.col(id_col).alias(loser))
    kept = docs.join(losers, docs[id_col] == F.col(loser), "left_anti")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(F.col(id_col).alias(loser))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept[id_col] == F.col(loser), "left_anti")
    rows = kept.join(repeated, kept[id_col] == F.col(loser), "left_semi")
    rows = rows.mapInArrow(_with_prints(docs.columns.index(text_col), (p1, p2)), T.StructType([*docs.schema, T.StructField(p1, T.LongType()), T.StructField(p2, T.LongType())]))
    order = Window.partitionBy(id_col).orderBy(F.col(p1).asc_nulls_last(), p2, F.col(text_col).asc_nulls_last(), F.to_json(F.struct(*docs.columns)))
    return once.unionByName(rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns))


SQL = f"""
with recursive words as (select doc_id id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') w from documents where doc_id is not null and text is not null),
shingles as (select distinct id, unnest(case when len(w) < {SHINGLE} then [array_to_string(w, ' ')] else [array_to_string(w[i:i + {SHINGLE - 1}], ' ') for i in range(1, len(w) - {SHINGLE - 2})] end) s from words where len(w) > 0),
sizes as (select id, count(*) n from shingles group by id),
shared as (select a.id u, b.id v, count(*) n from shingles a join shingles b on a.s = b.s and a.id <> b.id group by a.id, b.id),
pairs as materialized (select u, v from shared join sizes a on a.id = u join sizes b on b.id = v where shared.n >= {THRESHOLD} * (a.n + b.n - shared.n)),
reach(id, other) as (select u, v from pairs union select r.id, p.v from reach r join pairs p on p.u = r.other)
select id doc_id, least(id, min(other)) group_id from reach group by id"""
