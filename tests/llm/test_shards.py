"""BK-trees that prune, shards of every size, stars that spread."""

import collections

import numpy as np
import pytest
from termweave.llm import _shared, components, simhash
from test_operators import least_labels


def some_fingerprints(n=600, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**63), 2**63, n // 4, dtype=np.int64)
    flips = [np.bitwise_xor.reduce([np.int64(1) << np.int64(b) for b in rng.integers(0, 63, 3)]) for _ in range(n)]
    return np.unique(np.concatenate([base, rng.choice(base, n) ^ np.array(flips)]))


def labels_of(spark, edges):
    found = {r["u"]: r["v"] for r in components.components(edges).collect()}
    return found


def test_trees_prune():
    """Nodes looked at for a query, of a shard of random fingerprints."""
    rng = np.random.default_rng(1)
    fp, looked = np.unique(rng.integers(-(2**63), 2**63, 8192, dtype=np.int64)), []
    simhash.ties(np.zeros(len(fp), np.int64), fp, 3, looked)
    assert sum(looked) / len(fp) < 0.3 * len(fp)


@pytest.mark.parametrize("shard, forest, searched", [(8192, 1 << 17, 2048), (8, 1 << 17, 2048), (64, 20, 2048), (200, 1 << 17, 7), (64, 30, 5)])
def test_every_way_to_deal(spark, monkeypatch, shard, forest, searched):
    _shared.ship(spark)
    fp = some_fingerprints()
    nodes = spark.createDataFrame([(int(x),) for x in fp], "fp long").repartition(5)
    links = simhash.shard_links
    monkeypatch.setattr(simhash, "shard_links", lambda keyed, radius: links(keyed, radius, searched))
    found = labels_of(spark, simhash.links(nodes, 3, shard, forest))
    want = least_labels([int(x) & (1 << 64) - 1 for x in fp])
    assert [found.get(int(x), int(x)) for x in fp] == [int(fp[k]) for k in want]


def test_masks():
    rng = np.random.default_rng(5)
    for n, shard in ((10, 8192), (1 << 20, 8192), (1 << 36, 8192), (1 << 50, 8192), (1 << 63, 8192), (1 << 63, 1)):
        masks = simhash.blocks(n, 3, shard)
        assert len({bin(m).count("1") for m in masks}) == 1
        for _ in range(300):
            x = int(np.bitwise_xor.reduce([np.int64(1) << np.int64(k) for k in rng.integers(0, 62, 3)]))
            assert any(x & m == 0 for m in masks)
    assert all(bin(m).count("1") == 40 for m in simhash.blocks(1 << 63, 3))


@pytest.mark.parametrize("many", [components.MANY, 10])
def test_stars_and_chains(spark, many):
    star = [(0, k) for k in range(1, 3000)]
    chain = [(5000 + k, 5001 + k) for k in range(200)]
    ring = [(9000 + k, 9000 + (k + 1) % 50) for k in range(50)] + [(7, 7), (None, 3)]
    edges = spark.createDataFrame(star + chain + ring, "u long, v long").repartition(4)
    got = {r["u"]: r["v"] for r in components.components(edges, many).collect()}
    want = {k: 0 for k in range(1, 3000)} | {5001 + k: 5000 for k in range(200)} | {9000 + k: 9000 for k in range(1, 50)}
    assert got == want and collections.Counter(got.values())[0] == 2999
