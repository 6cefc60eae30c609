"""Near-duplicates of the pipeline against all pairs in plain Python."""

import random

import numpy as np
import pytest

from chunkframe.llm import bktree, near_text
from chunkframe.llm.bktree import BKForest


def plain(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {find(i) for i in range(len(texts))}


def test_edited_copies_go(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = ["", None, "one two", "One  two", "one two three four five", "one two three four five six"]
    line = [rng.choice(words) for _ in range(40)]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice((20, 60, 300)))] + line * rng.choice((0, 1))
        for edits in (0, 0, 1, 2, 4, 6, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in near_text.dedupe(df).collect()} == plain(texts)


def test_rows_without_id_and_no_rows(spark, edge):
    kept = near_text.dedupe(edge)
    assert kept.columns == edge.columns and kept.where("doc_id is null").count() == 1
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 1, 3, 8, 9, 10]
    assert near_text.dedupe(edge.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_dense_groups_and_split_shards(spark, monkeypatch, most):
    """A group whose members are often just below the threshold, over several shards, with
    and without a broadcast."""
    monkeypatch.setattr(bktree, "BROADCAST_BYTES", most)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for i in range(160):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 8))):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(words) for _ in range(3000)) for _ in range(2)]
    texts += [texts[-1].replace(texts[-1][100:900], "other words"), texts[-1] + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in near_text.dedupe(df, shard_rows=32).collect()} == plain(texts)


def test_texts_that_share_an_id(spark):
    rows = [(5, "one text with some words in it"), (5, "and quite another text of other words"), (5, "and quite another text of other words"), (4, "one text with some words in it")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(4, rows[3][1]), (5, rows[1][1])]
    from chunkframe.llm import simhash

    for f in (near_text.dedupe, simhash.dedupe):
        assert sorted(map(tuple, f(df).collect())) == want


def test_loads_refute_only_what_cannot_link():
    rng = np.random.default_rng(1)
    tokens, counts = np.sort(rng.integers(0, 2**64, 50, np.uint64)), np.arange(50)
    for n, least in ((40, 0.8), (1500, 0.8), (1500, 0.5)):
        base = rng.integers(0, 2**64, n, np.uint64)
        sets = [np.unique(np.concatenate((rng.choice(base, int(n * part), False), tokens, rng.integers(0, 2**64, int(n * (1 - part)), np.uint64)))) for part in rng.uniform(0.3, 1, 40)]
        loads = [near_text.prefix(s, tokens, counts, least).tobytes() for s in sets]
        held = near_text.Loads((np.frombuffer(b"".join(loads), np.uint8), np.cumsum([0, *map(len, loads)])), least)
        p, v = np.divmod(np.arange(1600), 40)
        kept = held.sharing(p, v, held)
        similar = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= least for a, b in zip(p, v)])
        assert kept[similar].all() and not kept.all()


def test_trees_prune():
    values = np.unique(np.random.default_rng(0).integers(0, 2**64, 2048, np.uint64))
    tree = BKForest(values, np.zeros(len(values), np.int64))
    found = [np.stack(x[:2]) for x in tree.within(values, np.zeros(len(values), np.int64), 2)]
    assert np.concatenate(found, 1).shape[1] == len(values) and tree.visited < 0.05 * len(values) ** 2


def test_candidates_at_the_threshold():
    """How many pairs at similarity 0.8 share a min-hash key and lie within the radius."""
    rng = np.random.default_rng(2)
    lost = 0
    for _ in range(2000):
        both = rng.integers(0, 2**64, 400, np.uint64)
        a, b = np.sort(both[:360]), np.sort(np.concatenate((both[:320], both[360:])))
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
        near = (near_text.simhash(a) ^ near_text.simhash(b)).bit_count() <= near_text.RADIUS
        lost += not (near and len(np.intersect1d(near_text.min_keys(a), near_text.min_keys(b))))
    assert lost <= 1
