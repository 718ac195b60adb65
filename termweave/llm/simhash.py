"""SimHash near-duplicates, found by BK-trees.

Fingerprints, one for each different value, are dealt into shards of some SHARD members so that any two within the radius
meet in one: the 64 bits are cut into blocks, and with `b` blocks and radius `r` two such fingerprints agree in b - r
blocks at least; each choice of b - r blocks, with as many of its bits as make shards of that size, is a way to deal
them. In a shard a BK-tree is built - children keyed by the integer Hamming distance to their parent - and every member
searches it, following only edges whose key is within the radius of its distance to the node. A shard's members ask in
blocks of SEARCHED: a larger shard's tree is stored and broadcast to the tasks that search it for a block each. All
trees at once are never sent, and no fingerprint comes to the driver. A shard that is too large for a task (FOREST), as
its members are much alike, is dealt again by its finest blocks, which leave 24 bits to differ in.

A task joins what it finds with union-find and passes on one edge a member, not the pairs; the components of all
edges give the groups.

Defined results: no words at all (null, empty, blank) is fingerprint 0, linked like any other; fewer words than a
shingle make one shingle; equal texts share a fingerprint; rows that repeat a doc_id are rows of their own; a null
doc_id is never a component's name unless its component has no other id (then null). An empty table gives an empty
result. Only doc_id and text are looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import _shared
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Members that a shard should have, and those that one task searches for; a larger shard's tree goes to several tasks.
SHARD, SEARCHED = 8192, 2048
#: Rows taken into one forest at once, and (query, node) pairs at once while searching.
FOREST, PAIRS = 1 << 17, 1 << 20
#: Blocks that the bits are cut into at most: the finest agreeing parts have 40 bits at radius 3.
FINEST = 8


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """The XXH64 of all shingles of a whole text, in order, repeats kept; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: exactly A-Z, and the six ASCII blanks
    if not words:
        return []
    if len(words) < shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined, ends = b" ".join(words), list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]


def majority(h: np.ndarray) -> int:
    """Bit i is set if more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if more than half of the shingles' XXH64 have it; 0 without words. Whole text, repeats counted."""
    return majority(np.array(shingle_hashes(text, shingle), np.uint64))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(t.as_py(), shingle)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fp"])

    schema = StructType([docs.schema["doc_id"], StructField("text_hash", LongType()), StructField("fp", LongType())])
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def forest(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all groups at once; group: the number of each row's tree, ascending.

    The first row of a group is its root. The others go below it, to the child of their distance: the first of those
    becomes that child, and so on, a level of all trees at a time. Returns the children of all nodes, one after another
    and ordered by key: first (of each node, in `child`), child, key; and roots (of each group).
    """
    n = len(fp)
    parent, key = np.full(n, -1), np.zeros(n, np.int64)
    rows, tree = np.arange(n), group.astype(np.int64)
    above = np.full(n, -1)
    while len(rows):
        first = np.concatenate([[True], (tree[1:] != tree[:-1])])
        head = rows[first][np.cumsum(first) - 1]
        parent[rows[first]] = above[first]
        rest = ~first
        rows, head, tree = rows[rest], head[rest], tree[rest]
        distance = np.bitwise_count(fp[rows] ^ fp[head]).astype(np.int64)
        key[rows] = distance  # to the node it hangs below so far
        order = np.lexsort((distance, tree))  # stable: rows keep their order
        rows, above = rows[order], head[order]
        mixed = tree[order] * 65 + distance[order]
        tree = np.cumsum(np.concatenate([[0], mixed[1:] != mixed[:-1]])) if len(mixed) else mixed
    roots = np.flatnonzero(parent < 0)
    order = np.lexsort((key, parent))[len(roots) :]
    first = np.searchsorted(parent[order], np.arange(n + 1))
    return first, order, key[order], roots


def search(trees: tuple, fp: np.ndarray, queries: np.ndarray, root: np.ndarray, radius: int, asked: np.ndarray | None = None, looked: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, node) within the radius; queries: places in `asked` (or fp). A step moves all searches one edge
    down. looked: gets the number of nodes that each step compares."""
    asked = fp if asked is None else asked
    first, child, key, _ = trees
    stack = [(queries, root)]
    while stack:
        q, node = stack.pop()
        if len(q) > PAIRS:
            half = len(q) // 2
            stack += [(q[half:], node[half:]), (q[:half], node[:half])]
            continue
        distance = np.bitwise_count(asked[q] ^ fp[node]).astype(np.int64)
        if looked is not None:
            looked.append(len(q))
        near = distance <= radius
        if near.any():
            yield q[near], node[near]
        n = first[node + 1] - first[node]
        below = n > 0
        q, node, distance, n = q[below], node[below], distance[below], n[below]
        if not len(q):
            continue
        # a block of searches at a time, so that what is looked at stays bounded
        for a in range(0, len(q), 1 << 17):
            part = slice(a, a + (1 << 17))
            m = n[part]
            at = np.repeat(first[node[part]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            follow = np.abs(key[at] - np.repeat(distance[part], m)) <= radius
            if follow.any():
                stack.append((np.repeat(q[part], m)[follow], child[at[follow]]))


def union(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (each the least row it is known to be tied to) after tying a to b."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def ties(key: np.ndarray, fp: np.ndarray, radius: int, looked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of whole shards, each a run of one key -> fingerprints (a, b) that tie together all that are within the radius."""
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    bits = fp.view(np.uint64)
    trees = forest(group, bits)
    label = np.arange(len(fp))
    for a, b in search(trees, bits, label.copy(), trees[3][group], radius, looked=looked):
        label = union(len(fp), a, b, label)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def asked_ties(trees: tuple, fp: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One shard's tree and some of its members -> fingerprints (a, b) that tie those to all that are within the radius."""
    at = np.argsort(fp, kind="stable")
    own = at[np.searchsorted(fp, asked, sorter=at)]
    label = np.arange(len(fp))
    roots = np.full(len(asked), trees[3][0])
    for q, node in search(trees, fp.view(np.uint64), np.arange(len(asked)), roots, radius, asked.view(np.uint64)):
        label = union(len(fp), own[q], node, label)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def blocks(n: int, radius: int, shard: int = SHARD) -> list[int]:
    """Masks of 64 bits, one for each choice of agreeing blocks, cut to the bits that make shards of some `shard` of n
    fingerprints; any two within the radius agree under one mask, whatever the number."""
    bits = max(0, (max(1, n) - 1) // shard).bit_length()
    count = next((b for b in range(radius + 1, FINEST) if bits <= 64 * (b - radius) // b), FINEST)
    edges = [64 * k // count for k in range(count + 1)]
    found = set()
    for kept in itertools.combinations(range(count), count - radius):
        # bits of each kept block in turn
        places = sorted((place - edges[k], place) for k in kept for place in range(edges[k], edges[k + 1]))
        found.add(sum(1 << place for _, place in places[:bits]))
    return sorted(found)


def _keyed(rows: DataFrame, masks: list[int], *more: str) -> DataFrame:
    """rows: fp -> fp, key: a row for each mask."""
    under = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)])
    return rows.select("fp", *more, F.explode(under).alias("k")).select("fp", F.xxhash64(*more, "k.i", "k.bits").alias("key"))


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD, forest_: int = FOREST) -> DataFrame:
    """nodes: fp, distinct -> edges (u, v) of fingerprints whose components are those of all pairs within the radius."""
    n = nodes.count()
    keyed = _keyed(nodes, blocks(n, radius, shard))
    large = _shared.stable(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > forest_).select("key"))
    if many := large.count():  # n * masks / forest_ of them at most
        large = F.broadcast(large) if many <= 1 << 16 else large
        fine = _keyed(keyed.join(large, "key", "left_semi").withColumnRenamed("key", "within"), blocks(1 << 63, radius), "within")
        keyed = keyed.join(large, "key", "left_anti").unionByName(fine)
    return shard_links(keyed, radius)


TREE_COLUMNS = "key long, part int, fp long, nodes binary, first binary, child binary, edge binary, u long, v long"


def shard_links(keyed: DataFrame, radius: int, searched: int = SEARCHED) -> DataFrame:
    """keyed: fp, key (its shards), distinct -> edges (u, v) whose components are those of all pairs within the radius that share a shard."""
    names = [c.split()[0] for c in TREE_COLUMNS.split(", ")]

    def rows(n: int, **columns) -> pa.RecordBatch:
        kinds = {"part": pa.int32(), **dict.fromkeys(("nodes", "first", "child", "edge"), pa.binary())}
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), kinds.get(c, pa.int64())) for c in names], names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards, each a run of one key -> the ties of small ones; the trees of others, once for each block of queries, and the queries."""
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            end = len(key) if final else int(new[-1])  # the last shard may go on
            held, n = [(key[end:], fp[end:])], len(key) - end
            sizes = np.diff(np.append(new[new < end], end))
            size = np.repeat(sizes, sizes)
            small = (size > 1) & (size <= searched)
            if small.any():
                a, b = ties(key[:end][small], fp[:end][small], radius)
                if len(a):
                    yield rows(len(a), u=a, v=b)
            for at, m in zip(new[new < end][sizes > searched].tolist(), sizes[sizes > searched].tolist(), strict=True):
                members, parts = fp[at : at + m], -(-m // searched)
                first, child, edge, _ = forest(np.zeros(m, np.int64), members.view(np.uint64))
                tree = [members.tobytes(), first.astype(np.int32).tobytes(), child.astype(np.int32).tobytes(), edge.astype(np.int8).tobytes()]
                for part in range(parts):
                    yield rows(1, key=[key[at]], part=[part], **dict(zip(("nodes", "first", "child", "edge"), ([x] for x in tree), strict=True)))
                yield rows(m, key=np.full(m, key[at]), part=(np.arange(m) % parts).astype(np.int32), fp=members)

        for batch in batches:
            held.append((batch["key"].to_numpy(), batch["fp"].to_numpy()))
            n += batch.num_rows
            if n >= FOREST:
                yield from out(False)
        if n:
            yield from out(True)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tree, then the queries that ask it, and so on; found ties are passed on."""
        trees, members, held = None, None, []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = asked_ties(trees, members, np.concatenate(held), radius)
                held.clear()
                if len(a):
                    yield pa.RecordBatch.from_pydict({"u": a, "v": b})

        for batch in batches:
            found = batch["u"].is_valid()
            if found.true_count:
                yield batch.filter(found).select(["u", "v"])
                batch = batch.filter(pa.array(~found.to_numpy(zero_copy_only=False)))
            tree = batch["nodes"].is_valid().to_numpy(zero_copy_only=False)
            ends = [*np.flatnonzero(tree).tolist(), batch.num_rows]
            if ends[0]:
                held.append(batch["fp"].slice(0, ends[0]).to_numpy(zero_copy_only=False))
            for at, end in zip(ends[:-1], ends[1:], strict=True):
                yield from out()
                members = np.frombuffer(batch["nodes"][at].as_py(), np.int64)
                first, child, edge = (np.frombuffer(batch[c][at].as_py(), t).astype(np.int64) for c, t in (("first", np.int32), ("child", np.int32), ("edge", np.int8)))
                trees = first, child, edge, np.zeros(1, np.int64)
                if end > at + 1:
                    held.append(batch["fp"].slice(at + 1, end - at - 1).to_numpy(zero_copy_only=False).astype(np.int64))
        yield from out()

    stored = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(build, TREE_COLUMNS)
    stored = _shared.spilled(stored, "trees")
    small = stored.where("u is not null").select("u", "v")
    sent = stored.where("u is null").repartition("key", "part").sortWithinPartitions("key", "part", F.col("nodes").isNull())
    return small.unionByName(sent.mapInArrow(look, "u long, v long"))


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, root (the least fingerprint of the component) and component_id for every row of docs."""
    rows = _shared.spilled(fingerprints(docs, shingle), "simhash")
    nodes = _shared.stable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = components(links(nodes.select("fp"), radius))  # u -> v, the least fingerprint of the component
    named = nodes.join(tied, nodes["fp"] == tied["u"], "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = _shared.stable(named.join(least, "root").select("fp", "root", "component_id"))
    return _shared.attach(rows, named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents of docs, whole: of each group one stays, the one with the smallest doc_id.

    Where several rows of a group have that id, one of them stays.
    """
    return firsts(docs, groups(docs, shingle, radius))


def firsts(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The documents of docs that stay, by groups(): doc_id, text_hash, root and component_id of every row."""
    rows = grouped.where("component_id <=> doc_id")
    # of a group's rows with that id the one of the least text hash; equal texts are told apart below
    stays = rows.groupBy("root", "doc_id").agg(F.min("text_hash").alias("h"), F.count(F.lit(1)).alias("n"))
    stays = _shared.stable(stays.select(F.col("doc_id").alias("__id"), F.col("h").alias("__hash"), F.col("n").alias("__n")))
    hashed = docs.select(_shared.whole(docs).alias("row"), F.xxhash64("text").alias("text_hash"))
    kept = hashed.join(stays, hashed["row"]["doc_id"].eqNullSafe(stays["__id"]) & (hashed["text_hash"] == stays["__hash"]))
    if not stays.where("__n > 1").isEmpty():
        first = kept.where("__n > 1").withColumn("id", F.col("row")["doc_id"]).dropDuplicates(["id", "text_hash"]).drop("id")
        kept = kept.where("__n = 1").unionByName(first)
    return kept.select("row.*")
