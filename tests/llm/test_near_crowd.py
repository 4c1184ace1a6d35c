"""Crowded regions of the forest: every link counts, however many documents are nearly as similar."""

import random

import numpy as np
from framelake.llm import near_dedup

from test_dedup import documents, shingle_set


def components(texts):
    """As in test_dedup, by one matrix product."""
    sets = [shingle_set(t, 4) for t in texts]
    place = {v: k for k, v in enumerate(set().union(*sets))}
    m = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[v] for v in s]] = 1
    both, n = np.rint(m @ m.T), m.sum(1)
    linked = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    root = np.arange(len(sets))
    while True:
        low = np.where(linked, root[None, :], len(sets)).min(1)
        if (low == root).all():
            return root.tolist()
        root = low


def test_near_finds_single_links_in_a_crowd(spark):
    """Members of one family are less alike than the threshold; each has one twin that reaches it."""
    rnd = random.Random(5)
    base, texts = [f"b{k}" for k in range(1200)], []
    for f in range(500):
        shared, *own = (lambda x: (x[:6], x[6:22], x[22:]))(rnd.sample(range(3, 1200, 6), 38))
        for twin in range(2):
            w = list(base)
            for k in shared + own[twin]:
                w[k] = f"f{f}_{k}"
            texts.append(" ".join(w))
    rnd.shuffle(texts)
    expected = components(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(spark, texts), shingle_words=4).collect()}
    wrong = [i for i in got if got[i] != expected[i]]
    assert len(set(expected)) > 200
    assert not wrong


def test_overlaps_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, hi, rng.integers(1, 400)).astype(np.uint64)) for hi in [50, 500, 5000, 100_000] for _ in range(20)]
    left, right = sets[::2], sets[1::2] + [np.zeros(0, np.uint64)]
    assert near_dedup.overlaps(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def test_spanning_keeps_components():
    assert sorted(near_dedup.spanning(np.array([1, 2, 3, 1, 9]), np.array([2, 3, 1, 3, 8]))) == [(1, 2), (1, 3), (8, 9)]
