"""Each operator against a plain Python version on small, awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from hitloom.llm import jaccard_join, neighbours, packing, passage_dedup, quality_classifier, quality_rules, sentencepiece_codec, sharding, stupid_backoff, suffix_dedup
from hitloom.llm.components import _star, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, block int, id string, cls string, spans string"


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(70)
    base = prose(150).split(" ")
    texts = [prose(200), None, "", "   \n\t ", "one", "a b c d", "A b C d", prose(120) + "\n" + shared + "\n" + prose(60), prose(90) + " " + shared + " " + prose(30)]
    texts += [" ".join(base)] * 3
    for k in range(6):
        near = list(base)
        near[10 + 20 * k] = "changed"
        texts.append(" ".join(near))
    texts += ["ab " * 400, "x" * 3000, "line one two\n" * 40, prose(3000), shared.upper(), "#$% | <>" * 30, "tab\tand  two  blanks ▁ ﬁ \x00"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, ["en", "de", None][i % 3], "s", 0, "k", 1, "i", "c", "s") for i, t in enumerate(corpus())]
    rows.append((rows[9][0], *rows[9][1:]))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.collect())


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_sentencepiece(docs, texts, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(map(tuple, sentencepiece_codec.digests(docs, MODEL).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted((i, len(e), sha(",".join(map(str, e))), sha(lib.decode(e))) for i, t in texts for e in [lib.encode(t)])
    assert sentencepiece_codec.digests(none, MODEL).count() == 0
    rng, c = random.Random(2), sentencepiece_codec.PrefixTableCodec(MODEL, cached=50, pairs=500)
    for _ in range(400):
        t = "".join(rng.choice(" ab\nthe漢▁é\tin") for _ in range(rng.randint(0, 40)))
        assert c.encode(t) == lib.encode(t)
        ids = [rng.randrange(3, 32000) if rng.random() < 0.5 else rng.randrange(3, 262) for _ in range(8)]
        assert c.decode(ids) == lib.decode(ids)


def test_sharding(spark, docs, none):
    got = sharding.shard(docs, 2000).collect()
    assert len(got) == docs.count()
    sums = collections.Counter()
    for r in got:
        sums[r.depth, r.prefix, r.part] += r.n_bytes
    rows = collections.Counter((r.depth, r.prefix, r.part) for r in got)
    assert all(v <= 2000 or rows[k] == 1 for k, v in sums.items())
    assert {(r.depth, r.prefix, r.part): r.shard_bytes for r in got} == dict(sums)
    same = spark.createDataFrame([(1, "x" * 900)] * 9 + [(None, "y")], "doc_id long, text string")
    assert max(r.shard_bytes for r in sharding.shard(same, 2000).collect()) <= 2000
    assert sharding.shard(none, 2000).count() == 0


def test_write_shards(spark, docs, none, tmp_path):
    rows = [(1, "x" * 900, "a", 5)] * 9 + [(None, "y" * 700, None, 6)] * 9 + [(None, None, "b", 7), (2, "z" * 50_000, "c", 8)] + [(k, "w" * (k % 500), "d", k) for k in range(3, 200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard string, slice int").repartition(3)
    name = sharding.write_shards(frame, 2000, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a")).collect()
    assert name == "shard_"
    assert collections.Counter(tuple(r[:4]) for r in back) == collections.Counter(rows)
    sums, count = collections.Counter(), collections.Counter()
    for r in back:
        sums[r[name]] += len(r.text or "")
        count[r[name]] += 1
    assert all(v <= 2000 or count[k] == 1 for k, v in sums.items())
    assert sharding.write_shards(docs, 4000, str(tmp_path / "b")) == "shard"
    assert spark.read.parquet(str(tmp_path / "b")).count() == docs.count()
    sharding.write_shards(none, 2000, str(tmp_path / "c"))


@pytest.mark.parametrize(("least", "order"), [(1, 3), (2, 3), (2, 2), (1, 1)])
def test_stupid_backoff(docs, texts, none, least, order):
    words = [(i, WORD.findall(t.translate(LOWER))) for i, t in texts]
    count = collections.Counter(tuple(w[k : k + n]) for _, w in words for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)
    want = []
    for i, w in words:
        s = late = single = 0
        for k in range(len(w)):
            longest = n = min(order, k + 1)
            while n > 1 and count[tuple(w[k + 1 - n : k + 1])] < least:
                n -= 1
            gram = tuple(w[k + 1 - n : k + 1])
            s += (longest - n) * math.log(0.4) + math.log(count[gram] / (count[gram[:-1]] if n > 1 else total))
            late += n < longest
            single += longest == order and count[tuple(w[k + 1 - order : k + 1])] == 1
        want.append((i, len(w), late, single, s))
    got = sorted(map(tuple, stupid_backoff.scores(docs, least, order).collect()))
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in sorted(want)])
    assert stupid_backoff.scores(none, least, order).count() == 0


def test_stupid_backoff_equal_batches_and_null_ids(spark):
    one = spark.createDataFrame([(7, "a b c a b"), (None, None), (None, "A")], "doc_id long, text string").coalesce(1)
    got = collections.Counter(map(tuple, stupid_backoff.scores(one.union(one)).collect()))  # two partitions alike, so two batches alike
    assert set(got.values()) == {2} and {g[:4] for g in got} == {(7, 5, 0, 0), (None, 0, 0, 0), (None, 1, 0, 0)}


def test_quality_rules(docs, texts, none):
    got = sorted(map(tuple, quality_rules.quality_rules(docs).collect()), key=str)
    want = []
    for i, t in texts:
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = collections.Counter(zip(w, w[1:], w[2:]))
        twice = {k + j for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice), failed))
    assert [g[:7] for g in got] == sorted(want, key=str)
    assert not any(g[6] and g[7] for g in got)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.keep_good(docs).count() == sum(g[7] for g in got)
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_classifier(spark, docs, none):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["foo", "bar", "baz.", "qux"]) + ("###" if i % 3 == 0 else "") for _ in range(60)), "en") for i in range(300)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.score(many, quality_classifier.train(many, labels)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == int(r.doc_id % 3 != 0) for r in held)
    assert quality_classifier.keep_good(many, labels).count() == sum(r.predicted for r in got)
    plain = quality_classifier.score(docs, quality_classifier.train(docs, labels.limit(0))).collect()
    assert len(plain) == docs.count() and {r.score for r in plain} == {0.5}
    assert quality_classifier.score(none, quality_classifier.train(none, labels)).count() == 0


def brute_removal(texts):
    seen, out = {}, []
    for i, t in sorted(set(texts)):
        b = t.encode()
        mark = np.zeros(len(b) + 1, dtype=int)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                mark[s] += 1
                mark[s + 100] -= 1
            else:
                seen[b[s : s + 100]] = 1
        gone = np.cumsum(mark)[:-1] > 0
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_dedup(docs, texts, none):
    got = sorted(set(map(tuple, suffix_dedup.removal(docs).collect())))
    assert got == sorted(brute_removal(texts))
    assert suffix_dedup.removal(docs).count() == len(texts)
    assert suffix_dedup.removal(none).count() == 0


def test_packing(spark, docs, texts, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in texts}
    got = packing.pack(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _ in texts)
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], dtype="<u4").tobytes())
    rows = collections.defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for v in rows.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(rows) == list(range(len(rows)))
    assert packing.pack(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_nnls():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, x = rng.random((12, 20)), np.where(rng.random(20) < 0.3, rng.random(20), 0)
        got = packing.nnls(a, a @ x)
        assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


def near_pairs(sets):
    ids = sorted(sets)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("short,block", [(16, 800_000), (2, 800_000), (2, 20)])
def test_jaccard_join(spark, docs, texts, none, monkeypatch, short, block):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "ROW_BLOCK", block)
    sets = {}
    for i, t in texts:
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for a, b in near_pairs(sets):
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(sets[i]), root[i]) for i, _ in texts)
    kept = [r.doc_id for r in jaccard_join.keep_first(docs).collect()]
    assert sorted(kept) == sorted(i for i in sets if root[i] == i)
    assert jaccard_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("block", [800_000, 300])
def test_jaccard_join_of_texts_that_share_most(spark, monkeypatch, block):
    """Rows made mostly of common shingles, about the wanted similarity: blocks of rows and sizes against brute force."""
    monkeypatch.setattr(jaccard_join, "SHORT", 3)
    monkeypatch.setattr(jaccard_join, "WIDE", 4)
    monkeypatch.setattr(jaccard_join, "ROW_BLOCK", block)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    lines = [[word() for _ in range(24)] for _ in range(3)]
    rows = []
    for i in range(90):
        base = lines[i % 3] + (lines[(i + 1) % 3] if i % 7 == 0 else [])
        rows.append((i, " ".join(base + [word() for _ in range(rng.randrange(0, 9))])))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}
    for a, b in near_pairs(sets):
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert 3 < len(set(root.values())) < 60


def test_parity_bits_never_lose_a_pair():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, rng.integers(1, 900), dtype=np.uint64)
        cut = rng.integers(0, max(1, len(a) // 6) + 1)
        b = np.concatenate([a[cut:], rng.integers(0, 1 << 63, rng.integers(0, max(1, len(a) // 7) + 1), dtype=np.uint64)])
        both, n, m = len(a) - cut, len(a), len(b)
        if m and 4 * both >= 3 * (n + m - both):
            assert jaccard_join.may_reach(jaccard_join.parity_bits(a), jaccard_join.parity_bits(b), n, m, 3, 4)


def test_components_by_stars(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    edges = chain.selectExpr("greatest(a, b) as a", "least(a, b) as b")
    for _ in range(12):
        edges = spark.createDataFrame(_star(_star(edges, True), False).collect(), "a long, b long")
    want = {(k, 0) for k in range(1, 41)} | {(101, 100)}
    assert {tuple(r) for r in edges.collect()} == want
    assert {(r.node, r.root) for r in components(chain).collect() if r.node != r.root} == want


def test_passage_dedup(docs, texts, none):
    got = {r.doc_id: r for r in passage_dedup.removal(docs).collect()}
    assert len(got) == len(set(i for i, _ in texts))
    rows = passage_dedup.with_spans(passage_dedup._keyed(docs.select("doc_id", "text")))
    spans = {r.id: np.frombuffer(r.spans, "<i8").reshape(-1, 2) for r in rows.where("spans is not null").collect()}
    seen = {}
    for i, t in sorted(set(texts)):
        w = WORD.findall(t.translate(LOWER))
        gone = np.zeros(len(w), dtype=bool)
        for a, e in spans.get(i, ()):
            gone[a:e] = len(w) >= 50
        for k in range(len(w) - 49):
            p = tuple(w[k : k + 50])
            if p in seen:
                assert gone[k : k + 50].all(), (i, k, seen[p])
            else:
                seen[p] = i, k
        assert got[i].n_removed_words == gone.sum()
    assert got[0].n_removed_words == 0
    first_copy, near = got[27], got[36]
    assert first_copy.n_removed_words == 0 and near.n_removed_words > 100
    cut = passage_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert passage_dedup.removal(none).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = [[float(x) for x in rng.normal(size=16)] for _ in range(700)]
    v[5] = v[100]
    rows = [(i, x) for i, x in enumerate(v)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (9005, [1.0] * 3), (None, v[3]), (200, v[200]), (42, v[42])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df.withColumn('leaf', F.lit('x')).withColumn('part', F.lit(1)), leaf=60, block=100, query_block=3, first=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = {i: np.array(e, dtype=np.float32).astype(float) for i, e in enumerate(v)}
    hits = 0
    for q in range(0, 700, 100):
        ids = [i for i in range(700) if i != q] + ([42] if q != 42 else [])
        d = sorted((float(np.sqrt(((x[q] - x[i]) ** 2).sum())), i) for i in ids)[:10]
        assert [s for _, s in got[q]] == sorted(s for _, s in got[q]) and len(got[q]) == 10
        hits += len({i for _, i in d} & {i for i, _ in got[q]})
    assert set(got) == set(range(0, 700, 100)) and hits >= 0.9 * 70
    assert got[100][0] == (5, 0.0)
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = neighbours.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 1.0)]


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0), (27, 1, 0), (54, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in pieces}
    assert 0 in kept and 27 in kept  # clean prose and the first of the copies
    assert not kept & {3, 6, 9, 12, 30, 33}  # empty, blank and short texts, and later copies
