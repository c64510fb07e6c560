"""Crowds of texts of one template, whose links spanning forests leave out."""

import random

import numpy as np

from poolgauge.llm import crowds, similar


def _set(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_shared_counts_heavy_and_light():
    rng = np.random.default_rng(4)
    sets = [[np.flatnonzero(rng.random(90) < p) for p in rng.random(n)] for n in (220, 170)]
    flat = [(np.repeat(np.arange(len(s)), [len(x) for x in s]), np.concatenate(s), len(s)) for s in sets]
    in_x, in_y = (np.bincount(f[1], minlength=90) for f in flat)
    assert (in_x * in_y > crowds.HEAVY).any() or (in_x * in_y).max() > 5_000
    want = [[len(np.intersect1d(a, b)) for b in sets[1]] for a in sets[0]]
    assert (crowds.shared_counts(*flat[0], *flat[1]) == np.array(want)).all()


def test_shared_counts_of_nothing():
    none = np.zeros(0, dtype=np.int64)
    assert crowds.shared_counts(none, none, 2, none, none, 3).tolist() == [[0] * 3] * 2


def test_no_link_of_a_template_crowd_is_lost(spark):
    """Twins at about 0.82 among 400 variants of one template at about 0.73, against all pairs."""
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(200):
        doc = list(base)
        for k in rng.sample(range(300), 2):
            doc[k] = word()
        for _ in range(2):
            twin = list(doc)
            for k in rng.sample(range(5, 295), 3):
                twin[k] = word()
            texts.append(" ".join(twin))
    sets, up = [_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    got = similar.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(len(texts)) if root(i) == i]
