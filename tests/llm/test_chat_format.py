"""Chat formatting: exact round trips, from ids and from text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from hitloom.llm import chat_format as cf

FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
SCHEMA = "conv_id long, turn long, role string, text string, part long, ids string, loss int"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/ROLE]", "<|endoftext|>", "\\", "<", "[", "]", "s>", "/s>", "INST]", "a", " ", "\n", "ß", "漢", "\x00", "<\\/s>", "[\\\\INST]"]


def noise(rng, n=12):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, n)))


def test_escapes():
    rng, t = random.Random(4), cf.Template()
    for _ in range(3000):
        text = noise(rng)
        safe = t.escape(text)
        assert t.unescape(safe) == text
        assert not any(c in safe for c in (*t.reserved(), *t.others))
    assert t.escape("plain \\ <b> [x]") == "plain \\ <b> [x]"
    with pytest.raises(ValueError):
        cf.Template(end="<s></s>").escape("")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """From the rows alone."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    result = []
    for conv, turns in out.items():
        turns.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        learned = "".join(x for *_, role, x in turns if role == "assistant")
        t = cf.Template()
        marks = dict(t.marks)
        written = "".join((marks.get(role) or f"{t.name}{t.escape(role)}{t.text}") + t.escape(x) + t.end for *_, role, x in turns)
        result.append((conv, len(turns), sha("".join(f"{role}\n{x}\n" for *_, role, x in turns)), len(learned), sha(learned), len(t.begin + written)))
    return sorted(result, key=str)


def conversations():
    rng = random.Random(9)
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, None, None), (2, 0, "assistant", ""), (None, 0, "user", "x"), (None, 1, "tool</s>", noise(rng))]
    rows += [(3, None, "system", "first"), (3, 5, "assistant", "y"), (3, 5, "assistant", "y")]
    rows += [(c, k, rng.choice(["user", "assistant", "assistant", "system", "critic", ""]), noise(rng, 40)) for c in range(10, 60) for k in range(rng.randint(1, 9))]
    rows += [(99, k, ["user", "assistant"][k % 2], f"turn {k} " + noise(rng, 200)) for k in range(3000)]
    rows += [(100, 0, "assistant", "long " * 100_000)]
    return rows


def test_digests(spark):
    rows = conversations()
    turns = spark.createDataFrame([(*r, 7, "i", 1) for r in rows], SCHEMA).repartition(5)
    made = cf.format_chats(turns, *FILE)
    want = plain(rows)
    assert sorted(map(tuple, cf.digests(made, *FILE, dealt=True).collect()), key=str) == want
    assert sorted(map(tuple, cf.digests(made, *FILE).collect()), key=str) == want
    assert cf.digests(cf.format_chats(turns.limit(0), *FILE), *FILE).count() == 0


def test_parts(spark, monkeypatch):
    """Parts are whole turns in order, and ids, mask and text agree."""
    monkeypatch.setattr(cf, "PART_TOKENS", 500)
    rows = conversations()
    tokens = cf.Tokens.of(cf.Template(), *FILE)
    parts = cf.format_chats(spark.createDataFrame([(*r, 7, "i", 1) for r in rows], SCHEMA), *FILE).collect()
    assert max(p.part for p in parts) > 0
    for p in parts:
        ids, loss = np.array(p.ids), np.array(p.loss)
        assert len(ids) == len(loss) and tokens.render(p.ids) == p.text
        turns = cf.turns_of_ids(ids, tokens)
        assert turns == cf.turns_of_text(p.text) and len(turns) == p.n_turns
        assert cf.learned(ids, loss, tokens) == "".join(t for r, t in turns if r == "assistant")
        assert not loss[ids >= tokens.first].any()
        assert (p.text.startswith("<s>")) == (p.part == 0) and p.text.endswith("</s>")
    numbers = {}
    for p in parts:
        numbers.setdefault(p.conv_id, []).append(p.part)
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())


def test_mask_counts_one_step_for_each_turn(spark):
    turns = spark.createDataFrame([(1, 0, "user", "aa"), (1, 1, "assistant", "bb"), (1, 2, "assistant", ""), (1, 3, "assistant", "cc")], "conv_id long, turn long, role string, text string")
    (row,) = cf.format_chats(turns, *FILE).collect()
    assert row.text == "<s>[INST]aa</s>[/INST]bb</s>[/INST]</s>[/INST]cc</s>"
    assert [x for x, m in zip(row.ids, row.loss, strict=True) if m] == [i for t in ("bb", "cc") for i in cf.Tokens.of(cf.Template(), *FILE).encode([t])[0]]
