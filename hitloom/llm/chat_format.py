"""Chat formatting at token level (operator 11).

Each turn's text is encoded by itself, and the turns of a conversation are
spliced together with reserved ids, which lie above the tokenizer's vocabulary
and which no text encodes to: begin, then for each turn the mark of its role,
the text and end.  Roles without a mark of their own are written out between
two further marks.  The loss mask is a prefix sum of steps: up where a trained
role's text begins, down where it ends.

Rendered as text, reserved ids are control strings, so those that occur in a
text or role are escaped: after the first character of a control string goes
one backslash more than stands there already.  That can be undone, leaves no
control string in any text, and touches nothing else.

Turns are encoded where they are read, in any order; what is shuffled are
their ids.  A task then goes through its conversations in order, an Arrow
batch at a time, and gives each out in parts of whole turns and some 65,536
ids, so a conversation of any length takes time but not memory.  What is read
back (``digests``) likewise keeps no more than running hashes.

Defined cases: a null text is empty, a null role is the role of no characters;
turns are put in order of turn (null first), equal ones by role and then by
ids, so that repeated rows are repeated turns; rows without a conversation are
one conversation of null id; a turn of any length is encoded as a whole; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_rows, lean, struct_batch
from .packing import encoder

C = F.col
PART_TOKENS = 1 << 16


@dataclass(frozen=True)
class Template:
    """Control strings; ``others`` are escaped besides, such as a tokenizer's added tokens."""

    begin: str = "<s>"
    end: str = "</s>"
    marks: tuple[tuple[str, str], ...] = (("system", "[SYS]"), ("user", "[INST]"), ("assistant", "[/INST]"))
    name: str = "[ROLE]"
    text: str = "[/ROLE]"
    trained: tuple[str, ...] = ("assistant",)
    others: tuple[str, ...] = ("<|endoftext|>",)

    def reserved(self) -> list[str]:
        """In the order of their ids."""
        return [self.begin, self.end, self.name, self.text, *(m for _, m in self.marks)]

    def pattern(self, least: int) -> re.Pattern:
        """Any control string with at least so many backslashes after its first character."""
        every = {*self.reserved(), *self.others}
        first = {c[0] for c in every}
        if len(every) != len(self.reserved()) + len(set(self.others)) or any(len(c) < 2 or "\\" in c or first & set(c[1:]) for c in every):
            raise ValueError("control strings need two characters and more, no backslash, and no first character of one within another")
        return re.compile("|".join(f"{re.escape(c[0])}\\\\{{{least},}}{re.escape(c[1:])}" for c in sorted(every)))

    def escape(self, text: str) -> str:
        return self.pattern(0).sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.pattern(1).sub(lambda m: m[0][0] + m[0][2:], text)


class Tokens:
    """Ids of escaped texts, their bytes, and the reserved ids of a template; one for each worker."""

    _made: dict = {}

    def __init__(self, template: Template, path: str, pattern: str):
        self.encoder = encoder(path, pattern)
        library = self.encoder.library
        byte_of = _byte_level()
        self.first = library.get_vocab_size()
        added = {t.content for t in library.get_added_tokens_decoder().values()}
        self.bytes = [b""] * self.first
        for token, i in library.get_vocab().items():
            self.bytes[i] = token.encode() if token in added else bytes(byte_of[c] for c in token)
        self.ids = {c: self.first + k for k, c in enumerate(template.reserved())}
        self.bytes += [c.encode() for c in template.reserved()]
        self.template = template
        self.mark = {role: self.ids[m] for role, m in template.marks}
        self.role = {i: role for role, i in self.mark.items()}
        self._escape, self._unescape = template.pattern(0), template.pattern(1)

    @classmethod
    def of(cls, *key) -> Tokens:
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(lambda m: m[0][0] + m[0][2:], text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return list(self.encoder.encode(pa.array([self.escape(t) for t in texts], pa.string())))

    def render(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode()


def _byte_level() -> dict[str, int]:
    from .packing import _bytes_of

    return _bytes_of()


ENCODED = "conv_id long, turn long, role string, ids array<int>"
FORMATTED = "conv_id long, part long, n_turns long, ids array<int>, loss array<boolean>, text string"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("text", pa.string())])


def encode_turns(turns: DataFrame, path: str, pattern: str, template: Template) -> DataFrame:
    """Each turn's escaped text as ids; null texts and roles as empty ones."""

    def run(batches):
        tokens = Tokens.of(template, path, pattern)
        for b in batches:
            ids = tokens.encode(b.column(3).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.list_(pa.int32()))], names=["conv_id", "turn", "role", "ids"])

    role = F.coalesce(C("role").cast("string"), F.lit("")).alias("role")
    return turns.select(C("conv_id").cast("long"), C("turn").cast("long"), role, C("text").cast("string")).mapInArrow(lean(run), ENCODED)


def _assemble(batch: pa.RecordBatch, tokens: Tokens, carry: dict) -> pa.RecordBatch:
    """Spliced ids, masks and text of a batch of turns in order; ``carry`` holds the conversation it breaks off in."""
    convs = batch.column(0).to_pylist()
    content = batch.column(3)
    flat, at = content.values.to_numpy(), content.offsets.to_numpy().astype(np.int64)
    trained = {tokens.mark[r] for r in tokens.template.trained if r in tokens.mark}
    before, learn, first = [], [], []
    for conv, role in zip(convs, batch.column(2).to_pylist(), strict=True):
        new = not carry or conv != carry["conv"]
        if new:
            carry.update(conv=conv)
        mark = tokens.mark.get(role)
        head = [mark] if mark is not None else [tokens.ids[tokens.template.name], *tokens.encode([role])[0], tokens.ids[tokens.template.text]]
        before.append([tokens.ids[tokens.template.begin], *head] if new else head)
        learn.append(mark in trained if mark is not None else role in tokens.template.trained)
        first.append(new)
    lead = np.array([len(h) for h in before], dtype=np.int64)
    own = np.diff(at)
    size = lead + own + 1
    end = np.cumsum(size)
    begin = end - size
    ids = np.empty(int(end[-1]), dtype=np.int32)
    ids[np.repeat(begin - np.cumsum(lead) + lead, lead) + np.arange(lead.sum())] = np.concatenate(before)
    ids[np.repeat(begin + lead - at[:-1], own) + np.arange(at[0], at[-1])] = flat[at[0] : at[-1]]
    ids[end - 1] = tokens.ids[tokens.template.end]
    step = np.zeros(len(ids) + 1, dtype=np.int8)
    learn = np.array(learn)
    np.add.at(step, (begin + lead)[learn], 1)
    np.add.at(step, (end - 1)[learn], -1)
    loss = np.cumsum(step[:-1]) > 0
    # a part ends where its conversation does, or with the turn that fills it
    full = end // PART_TOKENS
    cut = np.flatnonzero(np.concatenate([[True], np.array(first[1:], dtype=bool) | (full[1:] != full[:-1])]))
    stop = np.append(cut[1:], len(convs))
    parts = []
    for k in cut.tolist():
        carry["part"] = 0 if first[k] else carry["part"] + 1
        parts.append(carry["part"])
    offsets = pa.array(np.append(begin[cut], end[-1]), pa.int32())
    whole = ids.tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([convs[k] for k in cut.tolist()], pa.int64()),
            pa.array(parts, pa.int64()),
            pa.array(stop - cut),
            pa.ListArray.from_arrays(offsets, pa.array(ids)),
            pa.ListArray.from_arrays(offsets, pa.array(loss)),
            pa.array([tokens.render(whole[a:b]) for a, b in zip(begin[cut].tolist(), end[stop - 1].tolist(), strict=True)], pa.string()),
        ],
        schema=_FORMATTED,
    )


def format_chats(turns: DataFrame, path: str, pattern: str, template: Template = Template()) -> DataFrame:
    """conv_id, part, n_turns, ids, loss mask and text; parts of a conversation lie together and in order."""

    def run(batches):
        tokens, carry = Tokens.of(template, path, pattern), {}
        for b in batches:
            if b.num_rows:
                yield _assemble(b, tokens, carry)

    batch_rows(turns.sparkSession, 2000, 8 << 20)
    rows = encode_turns(turns, path, pattern, template).repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "ids").mapInArrow(lean(run), FORMATTED)


def turns_of_ids(ids: np.ndarray, tokens: Tokens) -> list[tuple[str, str]]:
    """Role and text of each turn of a part, from its ids alone."""
    out, role = [], None
    marks = np.flatnonzero(ids >= tokens.first).tolist()
    whole = ids.tolist()
    for k, at in enumerate(marks):
        mark = whole[at]
        stop = marks[k + 1] if k + 1 < len(marks) else len(whole)
        if mark in tokens.role:
            role = tokens.role[mark]
        elif mark == tokens.ids[tokens.template.name]:
            role = tokens.unescape(tokens.render(whole[at + 1 : stop]))
            continue
        elif mark != tokens.ids[tokens.template.text]:
            continue
        out.append((role, tokens.unescape(tokens.render(whole[at + 1 : stop]))))
    return out


def turns_of_text(text: str, template: Template = Template()) -> list[tuple[str, str]]:
    """The same from the text of a whole conversation or part: cut at control strings."""
    names = {m: role for role, m in template.marks}
    pieces = re.split("(" + "|".join(map(re.escape, template.reserved())) + ")", text)[1:]
    out, role = [], None
    for mark, own in zip(pieces[::2], pieces[1::2], strict=True):
        if mark == template.name:
            role = template.unescape(own)
        elif mark == template.text:
            out.append((role, template.unescape(own)))
        elif mark in names:
            out.append((names[mark], template.unescape(own)))
    return out


def learned(ids: np.ndarray, loss: np.ndarray, tokens: Tokens) -> str:
    """All text under the mask, each stretch unescaped by itself."""
    edge = np.diff(np.concatenate([[0], loss.astype(np.int8), [0]]))
    return "".join(tokens.unescape(tokens.render(ids[a:b].tolist())) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Running:
    """What is read back of one conversation so far."""

    def __init__(self, conv):
        self.conv, self.n, self.loss, self.chars = conv, 0, 0, 0
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


def digests(formatted: DataFrame, path: str, pattern: str, template: Template = Template(), dealt: bool = False) -> DataFrame:
    """Turns, learned text and length of each conversation, as its parts say; ``dealt``: parts lie as ``format_chats`` gives them."""

    def table(rows):
        return struct_batch(_DIGESTS, **{n: [r[k] for r in rows] for k, n in enumerate(_DIGESTS.names)})

    def run(batches):
        tokens, now = Tokens.of(template, path, pattern), None
        for b in batches:
            done = []
            lists = [b.column(n) for n in ("ids", "loss")]
            cut = [x.offsets.to_numpy() for x in lists]
            ids, loss = (x.values.to_numpy(zero_copy_only=False) for x in lists)
            for k, (conv, text) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Running(conv)
                own, mask = ids[cut[0][k] : cut[0][k + 1]], loss[cut[1][k] : cut[1][k + 1]]
                for role, said in turns_of_ids(own, tokens):
                    now.n += 1
                    now.turns.update(f"{role}\n{said}\n".encode())
                kept = learned(own, mask, tokens)
                now.loss += len(kept)
                now.learned.update(kept.encode())
                now.chars += len(text)
            yield table(done)
        if now is not None:
            yield table([now.row()])

    rows = formatted.select("conv_id", "part", "ids", "loss", "text")
    if not dealt:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(lean(run), DIGESTS)
