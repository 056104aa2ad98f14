"""Perplexity and bands against a plain Python model; each language has a model and a band of its own."""

import collections
import math
import random

import numpy as np
import pytest

from hitloom.llm import quality_rules


class Plain:
    """Interpolated modified Kneser-Ney over bytes."""

    def __init__(self, texts):
        rows = collections.Counter(t[k - 3 : k + 1] for t in texts for k in range(3, len(t)))
        self.levels = []
        for order in (4, 3, 2, 1):
            n = [sum(v == k for v in rows.values()) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
            d = (0.5, 0.75, 0.9) if min(n[:3]) == 0 else tuple(min(k - 0.05, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))
            total, gone = collections.Counter(), collections.Counter()
            for g, v in rows.items():
                total[g[:-1]] += v
                gone[g[:-1]] += d[min(v, 3) - 1]
            self.levels.append((dict(rows), d, total, gone))
            rows = collections.Counter(g[1:] for g in rows)

    def probability(self, g, level=0):
        if level == 4:
            return 1 / 256
        rows, d, total, gone = self.levels[level]
        low = self.probability(g[1:], level + 1)
        c = g[:-1]
        if not total[c]:
            return low
        v = rows.get(g, 0)
        return (v - d[min(v, 3) - 1] if v else 0) / total[c] + gone[c] / total[c] * low


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


def corpus():
    rng, rows = random.Random(4), []
    vocabulary = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(200)]
    for k, letters in enumerate(["aeioulmnrst", "abcdefgh", "äöüßkptz"]):
        words = vocabulary(letters)
        rows += [(1000 * k + i, sentence(rng, words, 80 + i % 50), ["en", "de", None][k]) for i in range(90)]
    rows += [(5000 + i, "".join(rng.choice("qwxzQ!7%") for _ in range(300)) + " " + sentence(rng, ["xq", "Zw!", "7%q"] + vocabulary("qwxzQ!7%"), 80), "en") for i in range(2)]  # nothing resembles it
    rows += [(6000 + i, " ".join("a" * rng.randint(3, 90) for _ in range(80)), "en") for i in range(2)]  # it says next to nothing
    rows += [(7000, None, "en"), (7001, "", None), (7002, "abc", "de"), (None, rows[0][1], "en"), rows[3], (7003, "lone language " + rows[5][1], "xx")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_against_a_plain_model(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    every = Plain([(t or "").encode() for _, t, _ in rows])
    by_lang = collections.defaultdict(list)
    for _, t, lang in rows:
        by_lang[lang].append((t or "").encode())
    models = {k: Plain(v) for k, v in by_lang.items()}
    got = collections.defaultdict(list)
    for r in quality_rules.quality_rules(docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    want = {}
    for i, t, lang in rows:
        b = (t or "").encode()
        grams = [b[k - 3 : k + 1] for k in range(3, len(b))]
        want[i] = -sum(math.log((models[lang].probability(g) + every.probability(g)) / 2) for g in grams) / len(grams) if grams else None
        for r in got[i]:
            assert (r.perplexity is None) == (want[i] is None)
            assert want[i] is None or math.log(r.perplexity) == pytest.approx(want[i], abs=1e-2)  # n-grams that share a hash
    for lang in by_lang:
        passed = sorted(math.log(r.perplexity) for i, _, own in rows if own == lang for r in got[i][:1] if not r.base_failed)
        if not passed:
            continue
        q1, q3 = (passed[max(0, math.ceil(f * len(passed)) - 1)] for f in (0.25, 0.75))
        width = quality_rules.SPREAD * max(q3 - q1, 0.02)
        for i, _, own in rows:
            for r in got[i] if own == lang else ():
                gap = 1 if r.perplexity is None else min(abs(math.log(r.perplexity) - x) for x in (q1 - width, q3 + width))
                assert gap < 0.02 or r.kept == (not r.base_failed and (r.perplexity is None or q1 - width <= math.log(r.perplexity) <= q3 + width))
    assert not any(r.kept for i in (5000, 5001, 6000, 6001) for r in got[i]) and not any(got[i][0].base_failed for i in (5000, 6000))
    assert math.log(got[5000][0].perplexity) > math.log(got[0][0].perplexity) > math.log(got[6000][0].perplexity)
    clean = [r for i, t, _ in rows if t and i is not None and i < 5000 for r in got[i]]
    assert all(r.kept for r in clean)


def test_no_language_is_pooled_and_columns_pass(spark):
    rng, rows = random.Random(4), []
    for k in range(40):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40)]
        for i in range(3 + (k < 20)):
            rows.append((1000 * k + i, sentence(rng, words, 80), f"l{k}" if k else None, "s", 1, 2.0, True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, slot string, kept int, log_perplexity double, base_failed boolean")
    model = quality_rules.fit_model(docs)
    assert len(set(model.slot_of.values())) == len(model.slot_of) == 40 and set(model.shared) == {*range(40), quality_rules.EVERY}
    kept = quality_rules.keep_good(docs)
    assert kept.schema == docs.schema
    ids = {x.doc_id for x in quality_rules.quality_rules(docs).where("kept").collect()}
    assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] in ids)
    assert quality_rules.quality_rules(docs.limit(0)).count() == quality_rules.keep_good(docs.limit(0)).count() == 0


def test_shares_sum_to_one(spark, rows):
    model = quality_rules.fit_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tables = model.tables(quality_rules.EVERY)
    for context in (b"aei", b"abc", b"zzz"):
        code = np.uint32(int.from_bytes(context + b"\0", "big")) + np.arange(256, dtype=np.uint32)
        assert tables.probability(code).sum() == pytest.approx(1, abs=0.1)  # an unseen n-gram may share a hash


def test_written_tables_are_erased_and_need_a_shared_folder(spark, monkeypatch):
    import os

    from hitloom.llm import common

    df = common.written(spark.range(5), "kept")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(folder)
    common._WRITTEN[:] = [x for x in common._WRITTEN if x[1].endswith(os.path.basename(folder))]
    monkeypatch.setattr(common, "_OWN", [])
    common.tidy()
    assert not os.path.exists(folder)

    class Other:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Other)
