"""Embedding near-duplicates by a robust-pruned flat graph.

1. Equal vectors are one from here on. Centroids (spherical k-means on a hashed sample,
   one centroid to about `SHARD_ROWS` vectors) divide the rest into shards that overlap:
   each vector is a member of its `OVERLAP` nearest ones.
2. Each shard builds a graph of its own: a vector's candidates, its nearest ones and some
   drawn at random, are pruned robustly (a candidate goes where an edge kept before is
   `ALPHA` times nearer to it than the vector is), and edges are made two-way.
3. A vector's adjacency lists from all its shards are united.
4. Every vector queries each shard whose centroid is almost as near as its nearest one's:
   two vectors at the threshold differ along a given direction by a deviation of
   sqrt(2 (1 - threshold) / dimensions), and the margin is `SIGMAS` of these. The number
   of shards asked so follows from the table, and partners on different sides of a border
   are found. A query is a greedy search with a beam of `BEAM` from the shard's medoid over
   the united lists; then the range expands, from each vector found at `THRESHOLD` or above
   to its neighbours, until it brings up no more.
5. What is found is verified with the exact cosine in double precision.
6. Recall is audited on `AUDIT_ROWS` hashed vectors: on all their partners by brute force
   over the whole table, and, for partners may be rare, on one made for each of them just
   above the threshold, which has to find it. While either recall is below `LEAST_RECALL`
   the search is repeated with twice the margin and beam, up to all shards.

Cases: null, empty and zero vectors, and those with nulls, NaN or infinities in them,
belong to no group; vectors of different lengths aren't compared, and may have any length;
rows with a null id are left out; rows that repeat an id count as one with the smallest of
its vectors; ties of distance go to the smaller id; an empty table has no groups; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .lineage import cut
from .minhash_dedup import components

#: Cosine from which two vectors are near-duplicates.
THRESHOLD = 0.95
SHARD_ROWS, OVERLAP, SAMPLE_PER_SHARD, ROUNDS = 2000, 2, 32, 6
#: Centroids, and vectors that the driver places them by, at most; a larger table has larger shards.
MOST_SHARDS, MOST_SAMPLED = 16_384, 65_536
#: Nearest and random candidates of a vector, edges kept of either, and the pruning factor.
NEAR, RANDOM, NEAR_EDGES, RANDOM_EDGES, ALPHA = 64, 48, 16, 12, 1.2
BEAM = 24
#: Deviations by which the centroid of a shard that is asked may be farther than the nearest one.
SIGMAS = 3.0
#: Audited vectors, the recall that is asked for, and how far above the threshold their made partners are.
AUDIT_ROWS, LEAST_RECALL, ABOVE = 200, 0.9, 0.002
#: Numbers in a block of similarities to centroids.
BLOCK = 4 << 20
MEMBER, VISITOR, MADE = 0, 1, 2


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as one array of float32."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from the sample's first k vectors."""
    x = unit(sample)
    c = x[:k].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        mean = np.zeros_like(c)
        np.add.at(mean, own, x)
        norm = np.linalg.norm(mean, axis=1, keepdims=True)
        c = np.where(norm > 0, mean / np.maximum(norm, 1e-30), c)
    return c


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, sims: np.ndarray, edges: int, alpha: float = ALPHA) -> np.ndarray:
    """Of each node's candidates (nearest first), the pruned neighbours; -1 where there are fewer."""
    b, c = cand.shape
    near = x[cand]
    dist = 1 - sims
    between = 1 - np.einsum("bik,bjk->bij", near, near, optimize=True)
    alive = cand != nodes[:, None]
    out = np.full((b, edges), -1, np.int64)
    row = np.arange(b)
    for e in range(edges):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        out[some, e] = cand[row, pick][some]
        alive &= ~(alpha * between[row, pick] <= dist + 1e-7)
        alive[row, pick] = False
    return out


def build(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """Two-way edges (from, to) of the flat graph over unit vectors."""
    n = len(x)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    rng = np.random.default_rng(seed)
    found = []
    for a in range(0, n, 256):
        nodes = np.arange(a, min(a + 256, n))
        sims = x[nodes] @ x.T
        sims[np.arange(len(nodes)), nodes] = -2
        k = min(NEAR, n - 1)
        cand = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        drawn = rng.integers(0, n, (len(nodes), min(RANDOM, n)))
        for c, edges in ((cand, NEAR_EDGES), (drawn, RANDOM_EDGES)):
            s = np.take_along_axis(sims, c, axis=1)
            order = np.lexsort((c, -s))
            c, s = np.take_along_axis(c, order, axis=1), np.take_along_axis(s, order, axis=1)
            to = robust_prune(x, nodes, c, s, edges)
            i, j = np.nonzero(to >= 0)
            found.append(np.stack([nodes[i], to[i, j]], axis=1))
    e = np.concatenate(found)
    return np.unique(np.concatenate([e, e[:, ::-1]]), axis=0)


def search(x: np.ndarray, edges: np.ndarray, threshold: float, beam: int, queries: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, found) pairs at the threshold or above, all vectors or `queries` being the queries, some hundred at a time."""
    n = len(x)
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    at = np.searchsorted(edges[:, 0], np.arange(n + 1))
    degree = np.diff(at)
    to = edges[:, 1]
    start = int((x @ x.mean(axis=0)).argmax())
    slack = threshold - 1e-5  # in single precision; what is found is verified in double
    every = x if queries is None else queries
    for a in range(0, len(every), 256):
        q = every[a : a + 256]
        b = len(q)
        seen = np.zeros((b, n), bool)
        done = np.zeros((b, n), bool)
        sims = np.full((b, n), -2, np.float32)
        seen[:, start] = True
        sims[:, start] = q @ x[start]
        ids = np.full((b, beam), -1, np.int64)
        ids[:, 0] = start
        live = np.arange(b)
        while len(live):
            width = ids[live]
            open_ = (width >= 0) & ~done[live[:, None], np.maximum(width, 0)]
            live, open_ = live[open_.any(axis=1)], open_[open_.any(axis=1)]
            if not len(live):
                break
            node = ids[live, open_.argmax(axis=1)]  # beams are sorted: the nearest that isn't expanded
            done[live, node] = True
            r, t = _spread(live, node, at, degree, to)
            new = ~seen[r, t]
            r, t = r[new], t[new]
            seen[r, t] = True
            sims[r, t] = np.einsum("ij,ij->i", q[r], x[t])
            # beams of these queries, with what is new in them
            size = np.bincount(np.searchsorted(live, r), minlength=len(live))
            most = int(size.max()) if len(size) else 0
            wide = np.full((len(live), beam + most), -1, np.int64)
            wide[:, :beam] = ids[live]
            i = np.searchsorted(live, r)
            wide[i, beam + np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)] = t
            s = np.where(wide >= 0, sims[live[:, None], np.maximum(wide, 0)], -3)
            top = np.argsort(-s, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(wide, top, axis=1)
        # the range: neighbours of all that are in it, until none is new
        r, t = np.nonzero(sims >= slack)
        front = ~done[r, t]
        r, t = r[front], t[front]
        while len(r):
            done[r, t] = True
            r, t = _spread(r, t, at, degree, to)
            new = ~seen[r, t]
            key = np.unique(r[new] * n + t[new])
            r, t = key // n, key % n
            seen[r, t] = True
            s = np.einsum("ij,ij->i", q[r], x[t])
            sims[r, t] = s
            r, t = r[s >= slack], t[s >= slack]
        r, t = np.nonzero(sims >= slack)
        yield a + r, t


def _spread(row: np.ndarray, node: np.ndarray, at: np.ndarray, degree: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, neighbour) for all neighbours of the nodes."""
    size = degree[node]
    place = np.repeat(at[node] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return np.repeat(row, size), to[place]


def _exact(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows a of x and rows b of y, in double precision."""
    out = np.empty(len(a))
    for i in range(0, len(a), 65_536):
        p, q = (z[k[i : i + 65_536]].astype(np.float64) for z, k in ((x, a), (y, b)))
        out[i : i + 65_536] = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number connected to each."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


def valid(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec, dim) of the rows that can be compared, one for each id."""
    vec = F.col("vec")
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(3e38)))
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id is not null and vec is not null")
    rows = rows.where((F.size(vec) > 0) & fine & F.exists(vec, lambda v: v != 0))
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, audit: list | None = None) -> DataFrame:
    """(id, group_id) of the members of all groups of near-duplicates; `audit` gets (dim, recall of true partners, of made ones, margin, beam) of each audit."""
    kind = table.schema[id_col].dataType
    rows = cut(valid(table, id_col, vec_col))
    reps = cut(rows.groupBy("vec", "dim").agg(F.min("id").alias("id")))
    edges = rows.join(reps.select("vec", F.col("id").alias("v")), "vec").where("id <> v").select(F.col("id").alias("u"), "v")
    for r in reps.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        own = reps.where(F.col("dim") == r.dim).select("id", "vec")
        margin, beam = max(SIGMAS * (2 * max(1 - threshold, 0) / r.dim) ** 0.5, 0.01), BEAM
        k = min(max(1, ceil(r.n / shard_rows)), MOST_SHARDS)
        sample = own.orderBy(F.xxhash64("id"), "id").limit(max(min(k * SAMPLE_PER_SHARD, MOST_SAMPLED), AUDIT_ROWS)).toArrow()
        x = matrix(sample.column("vec"))
        middles = centroids(x[: max(k, min(k * SAMPLE_PER_SHARD, MOST_SAMPLED))], k)
        asked = dict(zip(sample.column("id").to_pylist()[:AUDIT_ROWS], x[:AUDIT_ROWS]))
        made = _partners(x[:AUDIT_ROWS], min(threshold + ABOVE, 1.0))
        true = cut(_brute(own, asked, threshold))
        n_true = true.count()
        while True:
            found = cut(_search(own, middles, margin, beam, threshold, asked, made))
            hits = true.join(found.where("kind = 1").select("u", "v").distinct(), ["u", "v"]).count()
            recall = hits / n_true if n_true else 1.0, found.where("kind = 2").select("u").distinct().count() / len(asked)
            if audit is not None:
                audit.append((r.dim, *recall, margin, beam))
            if min(recall) >= LEAST_RECALL or margin >= 2 and beam > r.n:
                break
            margin, beam = margin * 2, beam * 2
        edges = edges.unionByName(found.where("kind = 0").select("u", "v"))
    groups = components(edges)
    return groups.select(F.col("id").cast(kind).alias(id_col), F.col("root").cast(kind).alias("group_id"))


def _partners(x: np.ndarray, cosine: float, seed: int = 5) -> np.ndarray:
    """For each vector one at the given cosine, in a random direction."""
    u = unit(x.astype(np.float64))
    away = np.random.default_rng(seed).normal(size=u.shape)
    away -= (away * u).sum(axis=1, keepdims=True) * u
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    return cosine * u + (1 - cosine**2) ** 0.5 * np.where(norm > 1e-9, away / np.maximum(norm, 1e-30), u)


def _brute(own: DataFrame, asked: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(u, v): all true pairs of the audited queries, each compared with every row."""
    ids, q = np.array(list(asked)), unit(np.array(list(asked.values()), np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                i, j = np.nonzero(unit(matrix(batch.column(1)).astype(np.float64)) @ q.T >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), batch.column(0).take(pa.array(i))], names=["u", "v"])

    return own.mapInArrow(run, "u bigint, v bigint").where("u <> v")


def shards_of(x: np.ndarray, middles: np.ndarray, margin: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, shard, role) of unit vectors: members of their nearest shards, visitors of others within the margin."""
    step = max(64, BLOCK // len(middles))
    most = min(OVERLAP, len(middles))
    for a in range(0, len(x), step):
        s = x[a : a + step] @ middles.T
        near = np.argpartition(-s, most - 1, axis=1)[:, :most]
        best = s.max(axis=1, keepdims=True)
        mask = s >= best - margin
        np.put_along_axis(mask, near, False, axis=1)
        r, c = np.nonzero(mask)
        yield a + np.append(np.repeat(np.arange(len(s)), most), r), np.append(near.ravel(), c), np.append(np.full(near.size, MEMBER), np.full(len(r), VISITOR))


def _search(own: DataFrame, middles: np.ndarray, margin: float, beam: int, threshold: float, asked: dict[int, np.ndarray], made: np.ndarray) -> DataFrame:
    """(u, v, kind): 0 links that join what was found in a shard, 1 all that audited vectors found, 2 made partners that found theirs."""
    kinds = "shard bigint, id bigint, vec array<float>, role int"

    def place(ids: pa.Array, vec: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row, shard, role in shards_of(x, middles, margin):
            for a in range(0, len(row), 8192):
                at = pa.array(row[a : a + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(shard[a : a + 8192].astype(np.int64)), ids.take(at), vec.take(at), pa.array(role[a : a + 8192].astype(np.int32))], names=["shard", "id", "vec", "role"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from place(batch.column(0), batch.column(1), unit(matrix(batch.column(1))))

    def graph(table):
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        e = build(unit(matrix(table.column("vec"))))
        at = np.searchsorted(e[:, 0], np.arange(len(ids) + 1))
        return pa.table({"id": ids, "near": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids[e[:, 1]]))})

    audited = np.sort(np.array(list(asked), np.int64))

    def find(table):
        table = table.sort_by([("role", "ascending"), ("id", "ascending")])
        every, role = table.column("id").to_numpy(), table.column("role").to_numpy()
        n = int((role == MEMBER).sum())
        raw = matrix(table.column("vec"))
        ids, x = every[:n], unit(raw[:n]) if n else raw[:0]
        near = table.column("near").slice(0, n).combine_chunks()
        to = near.flatten().to_numpy()
        row = np.repeat(np.arange(n), near.value_lengths().to_numpy())
        there = np.minimum(np.searchsorted(ids, to), max(n - 1, 0))
        here = ids[there] == to if n else np.zeros(0, bool)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if n:
            for a, b in search(x, np.stack([row[here], there[here]], axis=1), threshold, beam, unit(raw)):
                keep = (every[a] != ids[b]) | (role[a] == MADE)
                a, b = a[keep], b[keep]
                good = _exact(raw, raw, a, b) >= threshold
                us.append(a[good])
                vs.append(b[good])
        a, b = np.concatenate(us), np.concatenate(vs)
        real = role[a] != MADE
        root = _roots(len(every), a[real], b[real])
        link = np.flatnonzero(root != np.arange(len(every)))
        mine = np.flatnonzero(real & np.isin(every[a], audited))
        hit = np.flatnonzero(~real & (every[a] == ids[b] if n else real))
        parts = [(every[link], every[root[link]]), (every[a[mine]], ids[b[mine]]), (every[a[hit]], ids[b[hit]])]
        u, v = (np.concatenate(p) for p in zip(*parts))
        return pa.table({"u": u, "v": v, "kind": np.repeat(np.arange(3, dtype=np.int32), [len(p[0]) for p in parts])})

    spark = own.sparkSession
    placed = cut(own.mapInArrow(assign, kinds))
    lists = placed.where(F.col("role") == MEMBER).groupBy("shard").applyInArrow(graph, "id bigint, near array<bigint>")
    united = lists.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    members = placed.where(F.col("role") == MEMBER).join(united, "id").select(*placed.columns, "near")
    partners = pa.Table.from_batches(place(pa.array(list(asked), pa.int64()), pa.array(list(made.astype(np.float32)), pa.list_(pa.float32())), unit(made)))
    partners = partners.set_column(3, "role", pa.array(np.full(len(partners), MADE, np.int32)))
    asking = placed.where(F.col("role") == VISITOR).unionByName(spark.createDataFrame(partners).selectExpr("shard", "id", "vec", "role"))
    return members.unionByName(asking.withColumn("near", F.lit(None).cast("array<bigint>"))).groupBy("shard").applyInArrow(find, "u bigint, v bigint, kind int")


SQL = f"""
with recursive fine as (select vec_id id, min(embedding) v from embeddings where vec_id is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or isnan(x) or abs(x) >= 3e38]) = 0 and len([x for x in embedding if x <> 0]) > 0 group by vec_id),
pairs as materialized (select a.id u, b.id v from fine a join fine b on a.id <> b.id and len(a.v) = len(b.v) and list_cosine_similarity(cast(a.v as double[]), cast(b.v as double[])) >= {THRESHOLD}),
reach(id, other) as (select u, v from pairs union select r.id, p.v from reach r join pairs p on p.u = r.other)
select id vec_id, least(id, min(other)) group_id from reach group by id"""
