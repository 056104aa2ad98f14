"""The additive model against plain versions: trees by trying all cuts, scores by looking bins up one by one, the bounded sample."""

import bisect
import itertools
import math
import random

import numpy as np

from hitloom.llm import quality_classifier as qc


def gain(g, h):
    return g * g / (h + 1)


def test_trees():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        g, h = rng.normal(size=n), rng.random(n) * 4
        best = max((gain(g[:c].sum(), h[:c].sum()) + gain(g[c:].sum(), h[c:].sum()) - gain(g.sum(), h.sum()), c) for c in range(1, n) if h[:c].sum() >= 2 and h[c:].sum() >= 2) if any(h[:c].sum() >= 2 and h[c:].sum() >= 2 for c in range(1, n)) else (0, 0)
        got = qc._tree(g, h, 2, 2.0)
        cut = best[1] if best[0] > 0 else 0
        want = np.concatenate([np.full(cut, g[:cut].sum() / (h[:cut].sum() + 1)), np.full(n - cut, g[cut:].sum() / (h[cut:].sum() + 1))])
        np.testing.assert_allclose(got, want)
    for _ in range(30):
        g, h = rng.normal(size=(4, 5)), rng.random((4, 5)) * 3
        found = []
        for i, j in itertools.product(range(1, 4), range(1, 5)):
            cells = [(g[a, b].sum(), h[a, b].sum()) for a in (slice(0, i), slice(i, 4)) for b in (slice(0, j), slice(j, 5))]
            found.append(sum(gain(*c) for c in cells if c[1] >= 2))
        assert qc._pair_tree(g, h, 2.0)[1] == np.float64(max(found)) or abs(qc._pair_tree(g, h, 2.0)[1] - max(found)) < 1e-9


def test_fit_and_score():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    m = qc.fit(x, y, rounds=40, pairs=2)
    assert any({i, j} == {0, 1} for i, j, _ in m.pairs)
    for row, p in zip(x[:50], m.score(x[:50]), strict=True):
        z = m.intercept + sum(t[bisect.bisect_right(c.tolist(), v)] for c, t, v in zip(m.cuts, m.tables, row, strict=True))
        for i, j, t in m.pairs:
            z += t[bisect.bisect_right(m.coarse[i].tolist(), row[i]), bisect.bisect_right(m.coarse[j].tolist(), row[j])]
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-12
    loss = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert loss(m.score(x)) < 0.5 * loss(np.full(600, y.mean()))
    new = rng.normal(size=(600, 3))
    assert np.mean((m.score(new) > 0.5) == ((new[:, 0] * new[:, 1] > 0) | (new[:, 2] > 1))) > 0.85


def test_sample_is_bounded(spark, monkeypatch):
    """Rows that repeat a labelled id count once, and texts of any length are taken whole."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["foo", "bar."]) for _ in range(20)) + " ###" * (i % 2), "x") for i in range(80)]
    rows += [(7, f"copy {k}", "x") for k in range(500)] + [(8, "long " * 100_000, "x")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, y_ string").repartition(4)
    seen = []
    monkeypatch.setattr(qc, "fit", lambda x, y, fit=qc.fit: seen.append(len(x)) or fit(x, y))
    qc.train(docs, labels)
    qc.train(docs, labels, max_train=10)
    assert seen[0] <= 80 and seen[1] == 10
    scores = qc.score(docs, qc.train(docs, labels))
    assert scores.count() == len(rows) and scores.where("score < 0 or score > 1 or score is null").count() == 0
