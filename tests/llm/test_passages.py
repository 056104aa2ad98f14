"""Passages with words put in, left out or replaced, in many contexts, and repeated lines."""

import math
import random
import zlib

import numpy as np
import pytest

from hitloom.llm import passage_dedup


def removed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = passage_dedup.with_spans(passage_dedup._keyed(docs))
    out = [np.zeros(len(t.split()), dtype=bool) for t in texts]
    for r in rows.where("spans is not null").collect():
        for a, e in np.frombuffer(r.spans, "<i8").reshape(-1, 2):
            out[r.id][a:e] = len(out[r.id]) >= passage_dedup.MIN_WORDS
    return out


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def windows(texts, shared):
    """Windows about the five words from each place in shared on, under one signature."""
    side, width = passage_dedup.SIDE, passage_dedup.WIDTH
    head, grid = np.zeros(len(texts), dtype=passage_dedup._HEAD), np.zeros((len(texts), width), dtype=np.uint32)
    for i, (text, at) in enumerate(zip(texts, shared)):
        tokens = [zlib.crc32(" ".join(text[k : k + 5]).encode()) | 1 for k in range(len(text) - 4)]
        left, right = min(at, side), min(len(tokens) - at, side + 1)
        head[i] = 1, i, i, at, left, right
        grid[i, side - left : side + right] = tokens[at - left : at + right]
    return head, grid


@pytest.mark.parametrize("contexts", [8, 40])
@pytest.mark.parametrize("change", ["put in", "left out", "replaced"])
def test_one_rule_for_few_and_many_contexts(contexts, change):
    rng = random.Random(7)
    passage = words(rng, 60)
    texts, shared = [], []
    for k in range(contexts):
        own = list(passage)
        if k:  # two copies of the same change are near each other, too
            at = 25 + k % 30
            own[at : at + (change != "put in")] = [] if change == "left out" else words(rng, 1)
        texts.append(words(rng, 60) + own + words(rng, 60))
        shared.append(60 + 15)
    found = passage_dedup._compare(*windows(texts, shared))
    assert set(found[:, 0].tolist()) == set(range(1, contexts))
    # The copy of all windows but the first has the passage's first 25 words and most of the rest.
    for k in range(1, contexts):
        own = found[found[:, 0] == k]
        assert own[:, 1].min() <= -15 and own[:, 2].max() >= 31


def test_longest_is_that_of_brute_force():
    rng = np.random.default_rng(3)
    side, tokens, width = passage_dedup.SIDE, passage_dedup.TOKENS, passage_dedup.WIDTH
    for case in range(60):
        a = rng.integers(1, 1 << 31, width) if case % 3 else rng.integers(1, 60, width)
        b = a.copy()
        for _ in range(rng.integers(0, 9)):
            b[rng.integers(0, width)] = rng.integers(1, 1 << 31)
        b[side] = a[side]
        a[: rng.integers(0, 20)] = 0
        b[: rng.integers(0, 20)] = 0
        a, b = (x[None].astype(np.uint32) for x in (a, b))
        near, x, y = passage_dedup._longest(a, b, passage_dedup._own(a), passage_dedup._own(b), passage_dedup._reach(passage_dedup._same(a, b)))
        best = 0
        for lo in range(side + 1):
            for hi in range(max(side, lo + tokens - 1), width):
                p, q = a[0, lo : hi + 1], b[0, lo : hi + 1]
                if (q == 0).any() or (p != 0).sum() < tokens:
                    continue
                p, q = set(p[p != 0].tolist()), set(q.tolist())
                if 4 * len(p & q) >= 3 * len(p | q):
                    best = max(best, hi - lo + 1)
        got = int(y[0] - x[0] + 1) if near[0] else 0
        assert got >= best  # shifted strings may reach farther
        if got:
            q = set(b[0, x[0] : y[0] + 1].tolist())
            strings = [set(a[0, lo : hi + 1].tolist()) - {0} for lo in range(side + 1) for hi in range(max(side, lo + tokens - 1), width)]
            assert any(4 * len(p & q) >= 3 * len(p | q) for p in strings)


@pytest.mark.parametrize("changed", [0, 1])
def test_repeated_lines_are_compared_with_all(changed):
    rng = random.Random(8)
    line, texts = words(rng, 5), []
    for _ in range(12):
        own = words(rng, 9)
        texts.append(own * 5 + line + own * 5)
    own = list(texts[8][9:-9])
    for k in range(changed):
        own[20] = "other"
    texts.append(words(rng, 9) + own + words(rng, 9))
    found = passage_dedup._compare(*windows(texts, [45] * 13))
    assert set(found[:, 0].tolist()) == {12}
    assert found[:, 1].min() <= -36 and found[:, 2].max() >= 37


def test_a_window_is_compared_until_all_of_it_is_explained():
    rng = random.Random(9)
    text = words(rng, 120)
    texts = [words(rng, 20) + text[20:72] + words(rng, 48) for _ in range(10)]
    texts += [words(rng, 50) + text[50:105] + words(rng, 15), text]
    found = passage_dedup._compare(*windows(texts, [60] * 12))
    own = found[found[:, 0] == 11]
    assert own[:, 1].min() <= -40 and own[:, 2].max() >= 41


@pytest.mark.parametrize("change", ["put in", "left out", "replaced"])
def test_shifted_passages_in_many_contexts(spark, change):
    rng = random.Random(7)
    passage = words(rng, 60)
    texts, where = [], []
    for k in range(40):
        own = list(passage)
        if k >= 30:
            at = 20 + 2 * (k - 30)
            own[at : at + (change != "put in")] = [] if change == "left out" else words(rng, 1)
        before = words(rng, 60)
        texts.append(" ".join(before + own + words(rng, 60)))
        where.append((len(before), len(before) + len(own)))
    gone = removed(spark, texts)
    assert not gone[0].any()
    assert all(g[a + 4 : e - 4].all() for g, (a, e) in zip(gone[1:], where[1:]))


def test_hash_functions_miss_next_to_nothing():
    h, least = passage_dedup.HASHES, passage_dedup.AGREE
    assert sum(math.comb(h, k) * 0.75**k * 0.25 ** (h - k) for k in range(least)) < 0.02
    assert h - passage_dedup.CARRY < least  # whichever functions agree, one of them carries windows


def similar(a, b):
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    a, b = grams(a), grams(b)
    return 4 * len(a & b) >= 3 * len(a | b)


@pytest.mark.parametrize("copies", [3, 60])
def test_recall_and_precision_against_brute_force(spark, copies):
    """Passages of 60 words with a word replaced, put in or left out; in texts whose other words are their own."""
    rng = random.Random(copies)
    texts, where, groups = [], [], []
    for g in range(120 // copies + 1):
        passage = words(rng, 60)
        for k in range(copies):
            own, at, how = list(passage), rng.randrange(5, 55), rng.randrange(3)
            if k:
                own[at : at + (how != 0)] = [] if how == 1 else words(rng, 1)
            before = words(rng, rng.randrange(10, 90))
            texts.append(" ".join(before + own + words(rng, rng.randrange(10, 90))))
            where.append((len(before), len(before) + len(own)))
            groups.append((g, own))
    gone = removed(spark, texts)
    found = wanted = extra = 0
    for i, (g, own) in enumerate(groups):
        a, e = where[i]
        if any(h == g and similar(own, other) for h, other in groups[:i]):
            wanted += 1
            found += gone[i][a:e].sum() >= 0.8 * len(own)
        extra += gone[i][:a].sum() + gone[i][e:].sum()
        if not any(h == g for h, _ in groups[:i]):
            assert not gone[i].any()
    assert wanted > 70 and found >= 0.95 * wanted
    assert extra <= 14 * wanted  # a passage may take along as many neighbours as its similarity allows


def test_later_copies_of_short_texts_stay(spark):
    rng = random.Random(3)
    a, b = " ".join(words(rng, 49)), " ".join(words(rng, 50))
    docs = spark.createDataFrame([(5, a), (6, a), (7, b), (None, b), (8, b), (9, b), (9, b)], "doc_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_removed_words, r.n_spans) for r in passage_dedup.removal(docs).collect())
    assert got == [(-1, 0, 0), (5, 0, 0), (6, 0, 0), (7, 50, 1), (8, 50, 1), (9, 50, 1), (9, 50, 1)]
