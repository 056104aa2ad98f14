"""SentencePiece encoding and decoding by a prefix table (operator 1).

A merge-type (BPE) model splits every text in exactly one way, and every run
of tokens in that split is itself the split of its own text.  So each prefix
of a text has one last token.  The table stores it: an Aho-Corasick automaton
over the vocabulary lists the tokens that end at a place, and the token is
the one whose pair with the last token before it splits back into these two
(the pair-compatibility test, remembered).  Reading the table backwards from
the end gives the ids.

No piece holds anything before a word mark, so the text falls apart into
units (mark run and word); the table of a unit is made once for each worker
and kept in a cache of bounded size.

Defined cases: a null text is an empty one; an empty text has no ids and
decodes to the empty text; repeated rows give repeated rows; other columns
are ignored; very long words take time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_UNITS = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


class PrefixTableCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, model: str, cached: int = 200_000, pairs: int = 600_000):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces, self.scores, self.bytes = [], {}, {}
        self.kind = []
        self.unknown = lib.unk_id()
        auto = ahocorasick.Automaton()
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            special = lib.is_control(i) or lib.is_unknown(i)
            byte = lib.is_byte(i)
            self.pieces.append(piece)
            self.kind.append("special" if special else "byte" if byte else "text")
            if byte:
                self.bytes[int(piece[1:-1], 16)] = i
            elif not special:
                self.scores[piece] = (lib.get_score(i), i)
                auto.add_word(piece, (i, len(piece)))
        auto.make_automaton()
        self.width = len(self.pieces)
        self.decimal = [str(i) for i in range(self.width)]
        self.plain = [p.replace(MARK, " ") if k == "text" else None for p, k in zip(self.pieces, self.kind, strict=True)]
        self.automaton = auto
        self.chars = {p for p in self.scores if len(p) == 1}
        if "\n" in self.chars or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores):
            raise ValueError("the model has pieces across units")
        self.pairs: dict[int, bool] = {}
        self.max_pairs = pairs
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.max_cached = cached

    def _splits_back(self, left: int, right: int) -> bool:
        """Whether the text of two tokens splits into just these two."""
        a, b = self.pieces[left], self.pieces[right]
        parts = list(a + b)
        best_of = self.scores
        while len(parts) > 2:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = best_of.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s[0] > best):
                    best, where = s[0], i
            if where < 0:
                return False
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts == [a, b] and (a + b) not in best_of

    def _segment(self, text: str) -> list[int]:
        """Ids of a text without unknown characters, by its prefix table."""
        n = len(text)
        last, size_of = [-1] * (n + 1), [0] * (n + 1)
        pairs, width = self.pairs, self.width
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if size != end:
                before = last[end - size]
                if before < 0:
                    continue
                fits = pairs.get(before * width + token)
                if fits is None:
                    if len(pairs) >= self.max_pairs:
                        pairs.clear()
                    fits = pairs[before * width + token] = self._splits_back(before, token)
                if not fits:
                    continue
            last[end] = token
            size_of[end] = size
        out = []
        while n > 0:
            if last[n] < 0:
                raise ValueError(f"no split of {text!r}")
            out.append(last[n])
            n -= size_of[n]
        out.reverse()
        return out

    def _unit(self, unit: str) -> list[int]:
        if self.chars.issuperset(unit):
            return self._segment(unit)
        ids: list[int] = []
        known = ""
        for c in unit:
            if c in self.chars:
                known += c
                continue
            if known:
                ids += self._segment(known)
                known = ""
            ids += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
        return ids + (self._segment(known) if known else [])

    def _pieces_text(self, ids: list[int]) -> str:
        """Text of ids before the leading blank goes; bytes that are no UTF-8 become U+FFFD each."""
        out, raw = [], bytearray()

        def flush():
            while raw:
                try:
                    out.append(raw.decode())
                    raw.clear()
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start].decode() + "�")
                    del raw[: e.start + 1]

        for i in ids:
            kind = self.kind[i]
            if kind == "byte":
                raw.append(int(self.pieces[i][1:-1], 16))
                continue
            flush()
            if kind == "text":
                out.append(self.pieces[i].replace(MARK, " "))
            elif i == self.unknown:
                out.append(" ⁇ ")
        flush()
        return "".join(out)

    def _entry(self, unit: str) -> tuple[str, int, str]:
        got = self.old.get(unit)
        if got is None:
            ids = self._unit(unit)
            plain = [self.plain[i] for i in ids]
            got = (",".join([self.decimal[i] for i in ids]), len(ids), self._pieces_text(ids) if None in plain else "".join(plain))
        if len(self.young) >= self.max_cached:
            self.old, self.young = self.young, {}
        if len(unit) <= 64:
            self.young[unit] = got
        return got

    def _entries(self, text: str) -> list[tuple[str, int, str]]:
        if not text:
            return []
        get, entry = self.young.get, self._entry
        out = []
        for u in _UNITS.findall(MARK + text.replace(" ", MARK)):
            e = get(u)
            if e is None:
                e = entry(u)
                get = self.young.get
            out.append(e)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for e in self._entries(text) for i in e[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if self.kind[i] != "special" or i == self.unknown), None)
        text = self._pieces_text(ids)
        return text.removeprefix(" ") if first is not None and self.kind[first] == "text" else text

    def encode_decode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal joined by commas, decoded text."""
        entries = self._entries(text)
        return sum([e[1] for e in entries]), ",".join([e[0] for e in entries]), "".join([e[2] for e in entries]).removeprefix(" ")


_CODECS: dict[str, PrefixTableCodec] = {}


def codec(model: str) -> PrefixTableCodec:
    """One codec for each model and worker."""
    if model not in _CODECS:
        _CODECS[model] = PrefixTableCodec(model)
    return _CODECS[model]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """ids and decoded text of each document: doc_id, ids, decoded."""

    def run(batches):
        c = codec(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [c.encode(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """One row for each row of docs, as the module says; no shuffle."""

    def run(batches):
        c, sha = codec(model), hashlib.sha256
        for b in batches:
            n, ids, decoded = [], [], []
            for t in b.column(1):
                k, i, d = c.encode_decode(t.as_py() or "")
                n.append(k)
                ids.append(sha(i.encode()).hexdigest())
                decoded.append(sha(d.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
