"""The pipeline's near-copy stage: planted near copies against plain Jaccard similarities of word tuples."""

import random

import corpus_pipeline
import numpy as np
from termweave.llm import _shared, nearcopies

DOCS = "doc_id long, text string, lang string"


def words_of(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a or b else True


def plain_labels(sets):
    label = list(range(len(sets)))
    near = [[j for j in range(len(sets)) if alike(sets[i], sets[j])] for i in range(len(sets))]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(sets))]
        if new == label:
            return label
        label = new


def planted(n=60, seed=3):
    """Texts of 6 to 300 words, each with copies of which some words were changed, at both sides of the bound."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for i in range(n):
        w = [word() for _ in range([6, 25, 60, 300][i % 4])]
        texts.append(" ".join(w))
        for changes in (1, max(1, len(w) // 50), max(1, len(w) // 35)):
            copy = w.copy()
            for _ in range(changes):
                copy[rng.choice([0, -1, rng.randrange(len(w))])] = word()
            texts.append(" ".join(copy))
    texts += ["One two", "one  TWO", "two one", "", None, " "]
    return [(i, t, "en") for i, t in enumerate(texts)]


def test_stage_leaves_no_near_copies(spark, tmp_path):
    _shared.ship(spark)
    rows = planted()
    rows += [rows[5], (1, "another text with a known id", "en"), (None, rows[8][1], "en")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    sets = [words_of(t) for _, t, _ in rows]
    label = plain_labels(sets)
    want = set()
    for k in set(label):
        of = [i for i in range(len(rows)) if label[i] == k]
        want.add(min((rows[i][0] for i in of if rows[i][0] is not None)))
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert len(kept) == len(set(label)) < 150
    assert {r["doc_id"] for r in kept} == want
    left = [words_of(r["text"]) for r in kept]
    assert not any(alike(left[i], left[j]) for i in range(len(left)) for j in range(i))
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_ties_are_exact():
    rng = np.random.default_rng(7)
    for _ in range(100):
        base = [rng.choice(60, rng.integers(1, 30), replace=False) for _ in range(4)]
        sets = [np.unique(rng.permutation(b)[: max(1, len(b) - rng.integers(0, 5))]).astype(np.uint64) for b in base for _ in range(6)]
        assert nearcopies.tied(sets).tolist() == plain_labels([set(s.tolist()) for s in sets])


def test_large_groups_meet_once():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 40, 200).astype(np.uint64))
    sets = [np.unique(np.append(base, np.uint64(x))) for x in range(1500)]
    assert not nearcopies.tied(sets).any()


def test_ties_go_on_from_what_is_known():
    rng = np.random.default_rng(11)
    for _ in range(50):
        sets = [np.unique(rng.choice(40, rng.integers(1, 20), replace=False)).astype(np.uint64) for _ in range(20)]
        plain = nearcopies.tied(sets)
        before = np.where(rng.random(20) < 0.5, plain, np.arange(20))
        before = np.where(plain[before] == before, before, np.arange(20))
        assert nearcopies.tied(sets, label=before).tolist() == plain.tolist()


def test_groups_too_large_for_a_task(spark, monkeypatch):
    """Chains, whose ends are unlike, and groups of a text's copies, verified two texts at a time and a few at a time."""
    _shared.ship(spark)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [t for _, t, _ in planted(24)]
    w = [word() for _ in range(80)]
    for k in range(0, 60, 1):
        w[k] = word()
        texts.append(" ".join(w))
    base = [word() for _ in range(80)]
    for k in range(30):
        c = base.copy()
        for at in rng.sample(range(80), 1 + k % 4):
            c[at] = word()
        texts.append(" ".join(c))
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [rows[7], (None, texts[-1], "en")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    label = plain_labels([words_of(t) for _, t, _ in rows])
    want = {i: min(rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None) for i in range(len(rows))}
    want = sorted((rows[i][0] if rows[i][0] is not None else -1, want[i]) for i in want)
    # more hubs than parts, none that helps much, and no part of one text only
    for hubs, size in ((16, 2), (1, 2), (1, 7)):
        monkeypatch.setattr(nearcopies, "HUBS", hubs)
        got = nearcopies.groups(docs, texts=size, held=1 << 20).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"]) for r in got) == want
