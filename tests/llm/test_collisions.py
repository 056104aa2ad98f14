"""Long words whose polynomial hashes modulo 2**64 are equal for any base: the Thue-Morse string and its complement."""

import hashlib

import numpy as np
import pytest

from hitloom.llm import common, jaccard_join, passage_dedup, quality_rules, stupid_backoff, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [MORSE, OTHER, f"{MORSE}\n{OTHER}\nx", " ".join(["w"] * 60), MORSE.upper()]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


def test_hashes():
    data = np.frombuffer((MORSE + OTHER).encode(), np.uint8)
    starts, ends = np.array([0, 2048]), np.array([2048, 4096])
    a, b = common.span_hash(common.prefix_hash(data), starts, ends)
    assert a == b  # why longer spans go by a digest
    a, b = common.text_hash(data, starts, ends)
    assert a != b


def test_components(docs):
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}


def test_quality_rules(docs):
    got = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(docs).collect()}
    assert got[2] == (0, 0) and got[3] == (0, 60)


def test_backoff(docs):
    got = {r.doc_id: r.log_score for r in stupid_backoff.scores(docs).collect()}
    n = 1 + 1 + 3 + 60 + 1
    assert got[0] == pytest.approx(np.log(3 / n)) and got[1] == pytest.approx(np.log(2 / n))


def test_removals(spark):
    tail = " ".join(f"t{k}" for k in range(49))
    rows = spark.createDataFrame([(0, f"{MORSE} {tail}", "en", "s", 0), (1, f"{OTHER} {tail}", "en", "s", 0)], SCHEMA)
    assert all(r.n_removed_words in (0, 49, 50) for r in passage_dedup.removal(rows).collect())
    one = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.removal(spark.createDataFrame([(0, MORSE, "en", "s", 0), (1, OTHER, "en", "s", 0)], SCHEMA)).collect()}

    seen, want = set(), {}
    for i, text in enumerate((MORSE, OTHER)):
        gone = np.zeros(len(text), dtype=bool)
        for k in range(len(text) - 99):
            piece = text[k : k + 100]
            if piece in seen:
                gone[k : k + 100] = True
            seen.add(piece)
        kept = "".join(c for c, g in zip(text, gone, strict=True) if not g)
        want[i] = (int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    assert one == want
