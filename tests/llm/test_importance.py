"""Importance resampling against a plain version."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from hitloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
TEXTS = [None, "", "   ", "one", "One ONE one", "É été ß漢 7z_x", "a b " * 400, "w" * 5000 + " " + "v" * 70 + " x", "the quick brown fox jumps over the lazy dog " * 3, "\x00\x01 nul-s \x7f"]
TEXTS += [" ".join(f"w{(i * k) % 97}" for i in range(30 + k)) for k in range(1, 40)]


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain(rows, target, percent=25, least=20, seed=7, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        w, fs = features(text)
        g = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in map(bucket, fs)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    ranks = collections.defaultdict(list)
    for k, r in enumerate(drawn, 1):
        ranks[r].append(k)
    return sorted(((*r[:4], ranks[r].pop() if ranks[r] else None) for r in out), key=str)


@pytest.mark.parametrize("parts", [1, 3])
def test_same_as_plain(spark, parts):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[-1]), (None, None), (40, TEXTS[40]), (40, TEXTS[40])]
    docs = spark.createDataFrame([(i, t, "c", 1, b"p") for i, t in rows], "doc_id long, text string, chunk string, n long, packed binary").repartition(parts)
    target = spark.createDataFrame([(1, TEXTS[20]), (2, "The lazy DOG"), (3, None)], "doc_id long, text string")
    got = importance.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, [TEXTS[20], "The lazy DOG", None])
    few = importance.resample(docs, target.limit(0), percent=50, min_words=3, seed=1, buckets=300)
    assert sorted(map(tuple, few.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == plain(rows, [], 50, 3, 1, 300)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0


def test_crcs():
    words = [b"a", b"the", "été".encode(), b"z" * 63, b"y" * 64, b"x" * 65, b"q" * 1000]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    one, two = importance.feature_crcs(data, starts, ends, np.array([False] + [True] * (len(words) - 1)))
    assert one.tolist() == [zlib.crc32(w) for w in words]
    assert two.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]


def test_hot_buckets(spark):
    """A word that all documents repeat is more postings than a count of one byte holds, and its range is salted."""
    rows = [(i, "hot " * (300 + i) + f"w{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    target = spark.createDataFrame([(0, "hot w3")], "doc_id long, text string")
    got = importance.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, ["hot w3"])
