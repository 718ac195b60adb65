"""Approximate nearest neighbours by inner product, with robust-pruned directed graphs in every shard.

Equal vectors are one point of the index, so copies can't prune each other away; a point keeps the ids that could be
among k results, the k + 1 smallest (exact, as ties go to smaller ids). Points are dealt to shards by the hash of the
vector. In a shard they are cut into bands by their length, from the longest on, none in a band RATIO times longer than
another; each band has a graph of its own. There inner products become distances by one more coordinate, which gives all
points one length - in a band, of little weight, so that what tells points apart is not lost beside a few long ones.
The graph is grown in batches: each point's greedy beam search proposes what it has visited; robust pruning goes through
them from the nearest on, keeps one, and drops those that are ALPHA times nearer to it than to the point; the edges
are then turned round as well, and lists that grow too long are pruned again. The finished graphs are stored.

Queries are dealt in blocks; each meets each shard, where beam search from a band's middle finds candidates. These are
scored again on the original vectors in double precision. A band whose longest vector can't reach what a query has
found in longer bands is passed over, which loses nothing. A query's best of all shards are its neighbours. With
exact=True all points of a shard are scored, in blocks: the exact way, and what recall() measures the graphs against.

Defined results: vectors that are null, zero, of another length than most rows' (the first by count, then the
greater), or hold null or non-finite components are neither queries nor found; a null id likewise. Rows that repeat
an id are one thing with one or several vectors: it asks with all of them, is found at its best score, once, and never
by itself. An empty table gives an empty result. Only the id and vector columns are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _shared

K = 20
SHARD = 8192
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 40, 72, 144, 1.15
#: Nodes whose edges are followed at once, points searched for at once, candidates that pruning looks at.
WIDTH, BATCH, PROPOSED = 4, 512, 128
#: The longest vector of a band to its shortest.
RATIO = 1.25
#: Bytes of query vectors that a task has at once; each block of them reads each shard's graphs once.
QUERY_BYTES = 1 << 25


def search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the `beam` nearest points found, nearest first: positions (-1: none) and squared distances.

    edges: (points, degree), -1 where there is none.
    """
    b, n = len(q), len(x)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, n), bool)
    length = (x * x).sum(axis=1)
    own = (q * q).sum(axis=1)
    ids[:, 0], dist[:, 0] = start, length[start] + own - 2 * (q @ x[start])
    seen[:, start] = True
    while True:
        open_ = np.where(done | (ids < 0), np.inf, dist)
        take = np.argpartition(open_, min(WIDTH, beam) - 1, axis=1)[:, :WIDTH]
        row, col = np.nonzero(np.isfinite(np.take_along_axis(open_, take, 1)))
        if not len(row):
            return ids, dist
        at = take[row, col]
        done[row, at] = True
        found = edges[ids[row, at]]
        flat = (row[:, None] * n + found)[found >= 0]
        flat = np.unique(flat[~seen.ravel()[flat]])
        if not len(flat):
            continue
        seen.ravel()[flat] = True
        r, p = flat // n, flat % n
        d = length[p] + own[r] - 2 * np.einsum("ij,ij->i", x[p], q[r])
        better = d < dist[r, -1]
        r, p, d = r[better], p[better], d[better]
        counts = np.bincount(r, minlength=b)
        most = int(counts.max()) if len(r) else 0
        if not most:
            continue
        slot = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        more_ids, more = np.full((b, most), -1, np.int64), np.full((b, most), np.inf, np.float32)
        more_ids[r, slot], more[r, slot] = p, d
        ids, dist, done = np.concatenate([ids, more_ids], 1), np.concatenate([dist, more], 1), np.concatenate([done, np.zeros((b, most), bool)], 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, done = (np.take_along_axis(a, order, 1) for a in (ids, dist, done))


def prune(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each row of candidates (nearest first, -1: none) the diverse ones to keep, (rows, degree), -1 padded."""
    rows, n = ids.shape
    out = np.full((rows, degree), -1, np.int64)
    points = x[np.maximum(ids, 0)]
    length = (points * points).sum(axis=2)
    between = length[:, :, None] + length[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    alive = ids >= 0
    every = np.arange(rows)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[every, first]
        if not some.any():
            break
        out[some, k] = ids[every, first][some]
        alive[every, first] = False
        alive &= ~((alpha * alpha * between[every, first] <= dist) & some[:, None])
    return out


def middle(x: np.ndarray) -> int:
    return int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> np.ndarray:
    """The edges of a robust-pruned graph over the distinct rows of x, (points, degree), -1 padded."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int64)
    start = middle(x)
    rest = np.random.default_rng(n).permutation(n)
    rest = rest[rest != start]
    at, size = 0, 1
    while at < len(rest):
        new = rest[at : at + size]
        at, size = at + len(new), min(2 * size, BATCH)
        ids, dist = search(x, edges, start, x[new], beam)
        # points of one batch don't find each other by search
        d = ((x[new][:, None] - x[new][None]) ** 2).sum(axis=2) if len(new) <= 64 else (x[new] ** 2).sum(1)[:, None] + (x[new] ** 2).sum(1)[None] - 2 * x[new] @ x[new].T
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, : min(len(new) - 1, 16)]
        ids = np.concatenate([ids, new[near]], 1)
        dist = np.concatenate([dist, np.take_along_axis(d, near, 1).astype(np.float32)], 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :PROPOSED]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        edges[new] = prune(x, ids, dist, degree, alpha)
        # the same edges the other way round
        source, slot = np.nonzero(edges[new] >= 0)
        target, source = edges[new][source, slot], new[source]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        have = (edges[nodes] >= 0).sum(axis=1)
        put = np.arange(len(target)) - np.repeat(first, counts)
        wide = np.full((len(nodes), degree + int(counts.max())), -1, np.int64)
        wide[:, :degree] = edges[nodes]
        row = np.repeat(np.arange(len(nodes)), counts)
        wide[row, have[row] + put] = source
        fits = have + counts <= degree
        edges[nodes[fits]] = wide[fits, :degree]
        for k in range(0, int((~fits).sum()), BATCH):
            pick = np.flatnonzero(~fits)[k : k + BATCH]
            ids = wide[pick]
            ids.sort(axis=1)
            ids[:, 1:][(ids[:, 1:] == ids[:, :-1])] = -1
            points = x[np.maximum(ids, 0)]
            dist = ((points - x[nodes[pick]][:, None]) ** 2).sum(axis=2)
            dist[ids < 0] = np.inf
            order = np.argsort(dist, axis=1, kind="stable")[:, :PROPOSED]
            edges[nodes[pick]] = prune(x, np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), degree, alpha)
    return edges


def level(x: np.ndarray) -> np.ndarray:
    """float32 rows, the longest of length one, with one more coordinate that gives all one length: the nearest to a
    query is then the one of the largest inner product."""
    n = np.einsum("ij,ij->i", x, x)
    most = max(float(n.max(initial=0)), np.finfo(float).tiny)
    return np.concatenate([x / np.sqrt(most), np.sqrt(np.maximum(1 - n / most, 0))[:, None]], axis=1).astype(np.float32)


def bands(x: np.ndarray, ratio: float = RATIO) -> np.ndarray:
    """The number of each row's band: 0 from the longest row down to `ratio` times shorter ones, and so on."""
    length = np.linalg.norm(x, axis=1)
    order = np.argsort(-length, kind="stable")
    down, out, at, number = -length[order], np.zeros(len(x), np.int32), 0, 0
    while at < len(x):
        end = int(np.searchsorted(down, down[at] / ratio, "right"))
        out[order[at:end]] = number
        at, number = end, number + 1
    return out


class Best:
    """The k largest scores of each query so far, with their ids; ties to smaller ids."""

    def __init__(self, own: list, k: int):
        self.own, self.k = own, k
        self.found: list[list[tuple]] = [[] for _ in own]
        self.least = np.full(len(own), -np.inf)

    def add(self, query: int, scores: np.ndarray, ids: list) -> None:
        """scores of points, and the ids of each."""
        if len(scores) > self.k + 1:  # a point may be the query's own
            near = np.flatnonzero(scores >= np.partition(scores, -self.k - 1)[-self.k - 1])
        else:
            near = np.arange(len(scores))
        own = self.own[query]
        more = {i: -s for i, s in ((i, s) for at in near.tolist() for s in (float(scores[at]),) for i in ids[at] if i != own)}
        for s, i in self.found[query]:
            more[i] = min(s, more.get(i, s))
        self.found[query] = best = sorted((s, i) for i, s in more.items())[: self.k]
        if len(best) == self.k:
            self.least[query] = -best[-1][0]


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def usable(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """id, v (array of double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(id_).alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0.0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    # -0.0 and 0.0 are one number
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0)).withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))


def index(rows: DataFrame, k: int = K, shard: int = SHARD, graphs: bool = True) -> DataFrame:
    """rows: id, v -> shard, band, at, ids, v, edges (places in the band; none without graphs): the stored shards."""
    hashed = rows.distinct().withColumn("h", F.xxhash64("v"))
    first = Window.partitionBy("h", "v").orderBy("id")
    points = hashed.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)  # limited before the shuffle, too
    points = _shared.spilled(points.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "points")
    shards = max(1, -(-points.count() // shard))
    id_type = rows.schema["id"].dataType.simpleString()

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by("h")
        x = _matrix(t["v"], np.float64)
        band = bands(x)
        parts = [np.flatnonzero(band == k) for k in range(int(band.max(initial=-1)) + 1)]
        edges = [e for part in parts for e in build(level(x[part]))] if graphs else [[]] * len(x)
        t = t.take(np.concatenate(parts))
        return pa.table({"shard": t["shard"], "band": pa.array(np.sort(band)), "at": pa.array(np.arange(len(x)), pa.int32()), "ids": t["ids"], "v": t["v"], "edges": pa.array(edges, pa.list_(pa.int32()))})

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    return _shared.spilled(dealt.groupBy("shard").applyInArrow(grow, f"shard int, band int, at int, ids array<{id_type}>, v array<double>, edges array<int>"), "graphs")


def neighbours(rows: DataFrame, asks: Column, id_: str = "vec_id", vector: str = "embedding", k: int = K, shard: int = SHARD, beam: int = SEARCH_BEAM, exact: bool = False) -> DataFrame:
    """The k nearest other rows of each row where `asks` (of the column `id`) holds: query_id, rank, vec_id, score."""
    _shared.ship(rows.sparkSession)
    rows = usable(rows, id_, vector)
    graphs = index(rows, k, shard, not exact)
    shards = graphs.agg(F.max("shard")).first()[0]
    queries = rows.where(asks).distinct()
    sizes = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-sizes[0] * (sizes[1] or 1) * 8 // QUERY_BYTES))
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    id_type = rows.schema["id"].dataType.simpleString()
    queries = queries.select("id", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards or 0))).alias("shard"))
    trees = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(graph: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if graph.num_rows and asked.num_rows:
            graph = graph.sort_by("at")
            points, ids = _matrix(graph["v"], np.float64), graph["ids"].to_pylist()
            edges = None if exact else _matrix(graph["edges"], np.int64)
            q, own, band = _matrix(asked["v"], np.float64), asked["id"].to_pylist(), graph["band"].to_numpy()
            best, length = Best(own, k), np.linalg.norm(q, axis=1)
            for number in range(int(band[-1]) + 1):  # the longest vectors first
                a, b = np.searchsorted(band, [number, number + 1])
                part, names = points[a:b], ids[a:b]
                reach = length * np.linalg.norm(part, axis=1).max() * (1 + 1e-9)
                x = None if exact else level(part)
                start = None if exact else middle(x)
                for c in range(0, len(q), BATCH):
                    some = np.arange(c, min(c + BATCH, len(q)))
                    some = some[reach[some] >= best.least[some]]
                    if exact:
                        for n, scores in zip(some.tolist(), q[some] @ part.T, strict=True):
                            best.add(n, scores, names)
                    elif len(some):
                        unit = np.concatenate([q[some] / length[some, None], np.zeros((len(some), 1))], 1).astype(np.float32)
                        found, _ = search(x, edges[a:b], start, unit, beam)
                        for n, row in zip(some.tolist(), found, strict=True):
                            row = row[row >= 0]
                            best.add(n, part[row] @ q[n], [names[at] for at in row.tolist()])
            out = [(own[n], i, -s) for n, found in enumerate(best.found) for s, i in found]
        columns = list(zip(*out, strict=True)) or [()] * 3
        kinds = [asked["id"].type, asked["id"].type, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])

    found = trees.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(look, f"query_id {id_type}, vec_id {id_type}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(rows: DataFrame, asks: Column, **named) -> float:
    """The share of the exact neighbours of the asking rows that the graphs find."""
    near, exact = neighbours(rows, asks, **named), neighbours(rows, asks, exact=True, **named)
    pair = ["query_id", "vec_id"]
    hits = exact.select(*pair).join(near.select(*pair, F.lit(1).alias("hit")), pair, "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
