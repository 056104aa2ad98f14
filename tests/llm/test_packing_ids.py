"""Ids are those of the tokenizers library with its defaults, added tokens included."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from hitloom.llm import packing


def test_added_tokens_are_those_of_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a b<|endoftext|>c d", "<|endoftext|>", " <|endoftext|> \n<|endoftext|><|endoftext|>  x", "<|endoftext|", "a <|ENDOFTEXT|> b", "é<|endoftext|>漢  \n\n", "it's<|endoftext|>'s 12 345", "", None, "a" + " " * 1_000_000 + "b", "\n \t" * 2000 + "x", "ab" * 40_000, "漢字" * 3000, " " * 299 + "x" + " " * 301, "\u2003" * 400 + "\u0085\x1c\x1d y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect():
        got[r.doc_id].append(r)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        assert sum(r.length for r in got[i]) == len(ids) and {r.doc_tokens for r in got[i]} == {len(ids)}
        for r in got[i]:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())


def test_the_quick_encoder_is_the_library_for_all_characters():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, tok = packing.Encoder(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}1 {chr(c)}{chr(c)}b" for c in points[k : k + 1000]) for k in range(0, len(points), 1000)]
    differ = [k for k, (a, b) in enumerate(zip(own.encode(pa.array(texts)), tok.encode_batch(texts, add_special_tokens=False))) if a != b.ids]
    assert not differ


def test_little_padding(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, "a " * int(n)) for i, n in enumerate(rng.lognormal(5.5, 1.0, 4000).astype(int))], "doc_id long, text string")
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rows = got.agg({"length": "sum", "sequence_id": "max"}).first()
    assert rows["sum(length)"] >= 0.97 * 2048 * (rows["max(sequence_id)"] + 1)
