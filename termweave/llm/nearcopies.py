"""Near copies by the similarity of their texts: the pipeline's stage, wider than op5's three words and three bits.

Two texts are near copies when the Jaccard similarity of their sets of shingles - SHINGLE words each - is LEAST or more;
groups are the components of such pairs. At that similarity fingerprints differ in some 10 of 64 bits and more, a radius
for which neither agreeing bit blocks nor a BK-tree over all fingerprints leave anything out. So shards are made
otherwise: a text has BANDS keys, each of ROWS least hashes of its shingles, and texts that share a key meet. In a shard
a BK-tree finds the fingerprints within RADIUS; their components are candidate groups. A candidate group's texts meet, in
one task or part by part, and its links are verified by exact similarity, over every pair not tied already that a prefix
of the group's rarest shingles cannot rule out - which rules out no pair at LEAST or more.

What is verified is exact; what is found depends on the keys: a pair at 0.8 shares one with probability
1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9996, a closer one more surely.

Defined results: as in simhash.py; texts without a word are near copies of each other, and a text shorter than a shingle
is one shingle. Case of A-Z and white space make no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import _shared, simhash
from .components import components

SHINGLE, LEAST = 5, 0.8
#: Bits that near copies' fingerprints may differ in: 9.7 are expected at 0.8, with a deviation of 2.9.
RADIUS = 24
BANDS, ROWS = 20, 5
#: Texts, and distinct shingles of them together, that a task verifies at once; texts of a larger group that meet all its parts.
TEXTS, HELD, HUBS = 1 << 13, 1 << 21, 16
_draw = np.random.default_rng(20240301)
_FLIP, _ODD = _draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32), _draw.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * 2 + 1


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of all shingles of a whole text, in order, repeats kept; none without words."""
    return np.array(simhash.shingle_hashes(text, shingle), np.uint64)


def keys(distinct: np.ndarray) -> list[int]:
    """A key a band: the least of ROWS permutations of the shingles' hashes."""
    if not len(distinct):
        return [0]
    high, least = (distinct >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(high), 1024):
        np.minimum(least, ((high[k : k + 1024, None] ^ _FLIP) * _ODD).min(axis=0), out=least)
    return [simhash.signed(xxhash.xxh3_64_intdigest(band.tobytes(), j + 1)) for j, band in enumerate(least.reshape(BANDS, ROWS))]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), fp, n (distinct shingles) and keys of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, found = [], [], []
            for t in batch.column(2):
                h = shingles(t.as_py())
                distinct = np.unique(h)
                fps.append(simhash.signed(simhash.majority(h)))
                sizes.append(len(distinct))
                found.append(keys(distinct))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "fp", "n", "keys"],
            )

    added = [StructField("text_hash", LongType()), StructField("fp", LongType()), StructField("n", IntegerType()), StructField("keys", ArrayType(LongType()))]
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, StructType([docs.schema["doc_id"], *added]))


def tied(sets: list[np.ndarray], least: float = LEAST, label: np.ndarray | None = None) -> np.ndarray:
    """Sets of shingles, each sorted and distinct -> labels: the least place each set is tied to by pairs at `least` or more.

    label: what is known to be tied before. A set is compared with members of components it isn't in yet, and no more
    with a component once it is tied to it, so a group of copies of one text takes time by its number.
    """
    n = len(sets)
    up = list(range(n)) if label is None else label.tolist()

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def tie(i: int, j: int) -> None:
        i, j = sorted((top(i), top(j)))
        up[j] = i

    if n > 1:
        values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, count))] = np.arange(len(values))  # the rarest first
        ends = np.cumsum([len(s) for s in sets])
        ranks = np.split(rank[inverse], ends[:-1])
        sizes = np.array([len(s) for s in sets])
        size = sizes.tolist()
        seen: dict[int, dict[int, list[int]]] = {}  # shingle -> component -> members that have it in their prefix
        empty = None
        for i in np.argsort(sizes, kind="stable").tolist():  # the smaller sets before
            if not size[i]:
                empty = i if empty is None else empty
                tie(i, empty)
                continue
            # near copies share this many shingles at least, so one of the others' number, and one more, is shared
            prefix = np.sort(ranks[i])[: size[i] - int(np.ceil(least * size[i] - 1e-9)) + 1].tolist()
            compared = set()
            for x in prefix:
                parts = seen.setdefault(x, {})
                for r in [r for r in parts if up[r] != r]:  # tied to another since
                    members = parts.pop(r)
                    parts.setdefault(top(r), []).extend(members)
                for r, members in parts.items():
                    if top(r) == top(i):
                        continue
                    for k, j in enumerate(members):
                        if j in compared or size[j] < least * size[i] - 1e-9:
                            continue
                        compared.add(j)
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if both >= least * (size[i] + size[j] - both) - 1e-9:
                            tie(i, j)
                            members[0], members[k] = j, members[0]  # it may well be like the next one, too
                            break
                parts.setdefault(top(i), []).append(i)
    return np.array([top(i) for i in range(n)], np.int64)


def verified(members: DataFrame) -> DataFrame:
    """members: root, part, text_hash, tie, text -> text_hash, tie: the least hash of its part that a text is tied to by exact
    similarity, where it is not its own. A part is of one root, and is what a task holds; `tie` of members is what is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(hashes: list[int], known: list[int], sets: list[np.ndarray]):
            place = {}
            before = np.array([place.setdefault(t, k) for k, t in enumerate(known)], np.int64)
            label = tied(sets, label=before)
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                h = np.array(hashes, np.int64)
                yield pa.RecordBatch.from_pydict({"text_hash": h[moved], "tie": h[label[moved]]})

        at, hashes, known, sets = None, [], [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(4)]
            for root, part, h, tie, t in zip(*columns, batch.column(4), strict=True):
                if (root, part) != at:
                    yield from out(hashes, known, sets)
                    at, hashes, known, sets = (root, part), [], [], []
                if not hashes or hashes[-1] != h:  # rows that repeat a text come one after another
                    hashes.append(h)
                    known.append(tie)
                    sets.append(np.unique(shingles(t.as_py())))
        yield from out(hashes, known, sets)

    rows = members.select("root", "part", "text_hash", "tie", "text").repartition("root", "part")
    return rows.sortWithinPartitions("root", "part", "text_hash").mapInArrow(run, "text_hash long, tie long")


def _parts(n: str, size: str, texts: int, held: int) -> Column:
    """How many parts hold n texts of so many shingles together."""
    return F.ceil(F.greatest(F.col(n) / texts, F.col(size) / held)).cast("long")


def _dealt(hashed: Column, parts: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(hashed, F.lit(seed)), parts)


def large_ties(members: DataFrame, texts: int, held: int) -> DataFrame:
    """As verified(), for groups that are too large for a task. members: root, parts, n, text_hash, text, hub.

    A part of a group is verified in a task, and the group's hubs in every part of it: what is tied to a hub is one
    component, whatever its part. Those texts that are not of their group's largest component then meet every part,
    a block of them at a time. So of any two texts that aren't tied yet one meets the other.
    """
    members = _shared.spilled(members, "large")
    own = members.withColumn("part", _dealt(F.col("text_hash"), F.col("parts"), 1))
    glue = members.where("hub").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = _shared.stable(verified(own.unionByName(glue).withColumn("tie", F.col("text_hash"))))
    known = components(first.select(F.col("text_hash").alias("u"), F.col("tie").alias("v")))
    labels = own.select("root", "parts", "part", "n", "text_hash").distinct()
    labels = labels.join(known, labels["text_hash"] == known["u"], "left").withColumn("tie", F.coalesce("v", "text_hash")).drop("u", "v")
    labels = _shared.stable(labels)
    sizes = labels.groupBy("root", "tie").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("root").agg(F.max(F.struct("m", F.negative("tie").alias("tie"), F.col("tie").alias("largest")))["largest"].alias("largest"))
    largest = _shared.stable(largest)  # a row a large group
    rest = labels.join(F.broadcast(largest), "root").where("tie <> largest")
    totals = rest.groupBy("root").agg(F.count(F.lit(1)).alias("rest_n"), F.sum("n").alias("rest_size"))
    totals = _shared.stable(totals.select("root", _parts("rest_n", "rest_size", texts, held).alias("blocks")))
    if totals.isEmpty():
        return known.select(F.col("u").alias("text_hash"), F.col("v").alias("tie"))
    rest = rest.join(F.broadcast(totals), "root").withColumn("block", _dealt(F.col("text_hash"), F.col("blocks"), 2))
    asks = rest.select("root", "text_hash", "tie", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = labels.join(F.broadcast(totals), "root").select("root", "text_hash", "tie", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part")
    met = asks.unionByName(asked).distinct().select("text_hash", "tie", F.struct("part", "block").alias("part"))
    second = verified(members.select("root", "text_hash", "text").join(met, "text_hash").select("root", F.col("part").cast("string").alias("part"), "text_hash", "tie", "text"))
    edges = first.unionByName(second).select(F.col("text_hash").alias("u"), F.col("tie").alias("v"))
    return components(edges).select(F.col("u").alias("text_hash"), F.col("v").alias("tie"))


def groups(docs: DataFrame, texts: int = TEXTS, held: int = HELD) -> DataFrame:
    """doc_id, text_hash, root (a text hash that names the group) and component_id for every row of docs."""
    rows = _shared.spilled(sketches(docs), "nearcopies")
    distinct = rows.groupBy("text_hash").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.max("n").alias("n"), F.first("keys").alias("keys"))
    distinct = _shared.stable(distinct)
    keyed = distinct.select("fp", F.explode("keys").alias("key")).distinct()
    found = components(simhash.shard_links(keyed, RADIUS))
    candidates = distinct.join(found, distinct["fp"] == found["u"], "left").select("text_hash", "least", "n", F.coalesce("v", "fp").alias("root"))
    several = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size")).where("m > 1")
    several = _shared.stable(several.select("root", _parts("m", "size", texts, held).alias("parts")))
    dealt = _shared.attach(candidates, several, "root").where("parts is not null")
    dealt = _shared.stable(dealt.select("root", "parts", "n", F.col("text_hash").alias("__hash"), F.col("least").alias("__id")))
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    same = (hashed["text_hash"] == dealt["__hash"]) & hashed["doc_id"].eqNullSafe(dealt["__id"])
    members = hashed.join(dealt.where("parts = 1"), same).select("root", F.lit(0).alias("part"), "text_hash", F.col("text_hash").alias("tie"), "text")
    ties = _shared.stable(verified(members))
    large = dealt.where("parts > 1")
    if not large.isEmpty():
        order = Window.partitionBy("root").orderBy(F.xxhash64("__hash"), "__hash")
        hubs = large.select("root", "__hash").withColumn("place", F.row_number().over(order)).where(F.col("place") <= HUBS)
        hubs = _shared.stable(hubs.select(F.col("__hash").alias("h"), F.lit(True).alias("is_hub")))
        large = large.join(hubs, large["__hash"] == hubs["h"], "left").withColumn("hub", F.coalesce("is_hub", F.lit(False))).drop("h", "is_hub")
        same = (hashed["text_hash"] == large["__hash"]) & hashed["doc_id"].eqNullSafe(large["__id"])
        members = hashed.join(large, same).select("root", "parts", "n", "text_hash", "text", "hub")
        ties = ties.unionByName(large_ties(members, texts, held))
    named = distinct.select("text_hash", "least").join(ties, "text_hash", "left").select("text_hash", "least", F.coalesce("tie", "text_hash").alias("root"))
    named = _shared.stable(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = _shared.stable(_shared.attach(named, least, "root").select("text_hash", "root", "component_id"))
    return _shared.attach(rows.select("doc_id", "text_hash"), named, "text_hash").select("doc_id", "text_hash", "root", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents of docs, whole: of each group of near copies one stays, the one with the smallest doc_id."""
    return simhash.firsts(docs, groups(docs))
