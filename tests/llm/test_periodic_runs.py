"""Periodic runs against all pairs of start and period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from hitloom.llm import periodic_runs as pr
from hitloom.llm.queries import planted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=6, times=4):
    n, found = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, times * q) and not any(q % d == 0 and all(w[k] == w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_planted(i, w):
    h, n = zlib.crc32(("" if i is None else str(i)).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def plain(i, text):
    w = plain_planted(i, WORD.findall(text or ""))
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def sequences():
    rng = random.Random(3)
    for _ in range(150):
        yield [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(0, 60))]
    for _ in range(100):
        block = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        yield [rng.randrange(3) for _ in range(rng.randint(0, 9))] + block * rng.randint(2, 9) + block[: rng.randint(0, len(block))] + [rng.randrange(3) for _ in range(5)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield [int(c) for k in range(200) for c in bin(k).count("1").__mod__(2).__str__()]  # no cube anywhere


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (8, 5), (4, 3)])
def test_runs_of_sequences(least, times):
    rows = [np.array(s, dtype=np.int64) for s in sequences()]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    found, cut = pr.runs_of_rows(np.concatenate(rows), at, least, times)
    for k, r in enumerate(rows):
        assert [tuple(x) for x in found[cut[k] : cut[k + 1]].tolist()] == plain_runs(r.tolist(), least, times), r.tolist()


def whole(r, **how):
    return pr.find_runs(r, np.array([0]), np.array([len(r)]), 2, 2, **how)


def test_without_hashes_and_deceived(monkeypatch):
    rows = [np.array(s, dtype=np.int64) for s in list(sequences())[::7]]
    want = [plain_runs(r.tolist(), 2, 2) for r in rows]
    assert [[tuple(x) for x in whole(r, hashed=False).tolist()] for r in rows] == want
    monkeypatch.setattr(pr, "mix", lambda x: x * np.uint64(0) + np.uint64(1))  # every stretch has its length's hash
    assert [[tuple(x) for x in whole(r).tolist()] for r in rows] == want


def test_query(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a", "a a a a a a", "a b " * 2000, "ß é " * 7 + "\x0b漢 x", "x" * 5000 + " y " * 30]
    texts += [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[7]), (None, None), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, "r", 1, [1]) for i, t in rows], "doc_id long, text string, runs string, h long, words array<int>").repartition(3)
    got = pr.digests(pr.collapse(planted(docs)))
    want = sorted((plain(i, t) for i, t in rows), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    listed = sorted((r.doc_id, r.start, r.length, r.period) for r in pr.runs(docs.where("doc_id is not null")).collect())
    assert listed == sorted((i, *r) for i, t in rows if i is not None for r in plain_runs(WORD.findall(t or "")))
    assert pr.digests(pr.collapse(docs.limit(0))).count() == 0
