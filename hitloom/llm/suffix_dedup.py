"""Exact substring removal by prefix-free parsing and suffix arrays (operator 6).

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts
earlier in the corpus (smaller doc_id, or the same document and an earlier
start).

Parsing: a rolling hash over ``GRAM`` bytes is a trigger where it is the least
(the leftmost, on ties) of the grams of some string of LENGTH bytes.  Each
trigger makes a phrase: all strings whose least gram it is, which are
neighbours in the text.  Every string is in one phrase, and equal strings have
their triggers at the same place, so they can only be in phrases of equal
trigger grams.  The parse is cut down and sorted in three steps:

1. Trigger hashes go to hash blocks, packed; a hash that a batch holds more
   than once goes there once only.  Blocks report the triggers whose hash is
   not alone, to their documents.
2. Documents take up their reports and send just these phrases, packed, to
   blocks by trigger.  Equal phrases of a batch are sent once, for their first
   occurrence: the others are repeats as a whole.
3. A block's distinct phrases are its dictionary.  Their suffix array, to
   depth LENGTH, is made by prefix doubling; phrases' occurrences (the parse)
   put equal suffixes into corpus order, and all but the first string of each
   are repeats.  Spans go back to their documents and are cut out.

The text is exchanged once, by row, and read for steps 2 and 3 from there.  A
phrase that a third of all documents share comes into its block once for each
batch of input, not for each document.

Defined cases: a null text is empty; a null id is smaller than all others;
rows with equal id and text are one document reported as often; of rows with
equal id and different texts the order is that of their hashes; texts shorter
than LENGTH stay whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .common import U64, Chunk, batch_rows, lean, partitions, prefix_hash, span_hash, text_chunks, text_hash

LENGTH = 100
GRAM = 32
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_LOW = U64(0xFFFFFFFF)


class Parse:
    """Phrases of a chunk: row, first and last string start, trigger hash; and their offsets by row."""

    def __init__(self, chunk: Chunk):
        n, rows = len(chunk.data), len(chunk)
        self.row = self.lo = self.hi = np.zeros(0, dtype=np.int64)
        self.hash, self.at = np.zeros(0, dtype=U64), np.zeros(rows + 1, dtype=np.int64)
        if n < LENGTH:
            return
        prefix = prefix_hash(chunk.data)
        grams = n - GRAM + 1
        start = np.arange(grams)
        h = span_hash(prefix, start, start + GRAM)
        least = (h & ~_LOW) | start.astype(U64)
        span, need = 1, LENGTH - GRAM + 1
        while span * 2 <= need:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < need:
            least = np.minimum(least[: len(least) - (need - span)], least[need - span :])
        row_of = np.repeat(np.arange(rows), np.diff(chunk.offsets))[: len(least)]
        good = np.flatnonzero(np.arange(len(least)) + LENGTH <= chunk.offsets[row_of + 1])
        if not len(good):
            return
        trigger = (least[good] & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
        self.lo, self.hi = good[cut], good[np.append(cut[1:], len(good)) - 1]
        self.row, self.hash = row_of[self.lo], h[trigger[cut]]
        self.at = np.searchsorted(self.row, np.arange(rows + 1))


def _by_block(h: np.ndarray, blocks: int):
    block = ((h >> U64(17)) % U64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(blocks + 1))
    return [(k, order[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts))]


def _parts(keys: np.ndarray, items: np.ndarray, blocks: int):
    """Items of keys, packed by the part that a key belongs to: part numbers and bytes."""
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort((keys[order] % blocks), kind="stable")]
    keys, items = keys[order], items[order]
    cuts = np.searchsorted(keys % blocks, np.arange(blocks + 1))
    used = np.flatnonzero(np.diff(cuts))
    return used, [np.int64(cuts[k + 1] - cuts[k]).tobytes() + keys[cuts[k] : cuts[k + 1]].tobytes() + items[cuts[k] : cuts[k + 1]].tobytes() for k in used]


def by_key(parts: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row for each key with all its items, packed."""

    def run(batches):
        keys, items = [], []
        for b in batches:
            for x in b.column(0):
                raw = x.as_buffer()
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                keys.append(np.frombuffer(raw, np.int64, n, 8))
                items.append(np.frombuffer(raw, np.uint8, offset=8 + 8 * n).reshape(n, -1))
        if not keys:
            return
        keys, items = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        keys, items = keys[order], items[order]
        cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = items.shape[1]
        edge = np.append(cut, len(keys)) * size
        for lo in range(0, len(cut), 10_000):
            own = edge[lo : lo + 10_001]
            data = items.reshape(-1)[own[0] : own[-1]]
            packed = pa.Array.from_buffers(pa.large_binary(), len(own) - 1, [None, pa.py_buffer((own - own[0]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys[cut[lo : lo + 10_000]]), packed], names=["key", name])

    return parts.repartitionById(blocks, "part").select("packed").mapInArrow(run, f"key long, {name} binary")


def repeated_triggers(rows: DataFrame, blocks: int, parse=Parse) -> DataFrame:
    """key (of a row) and marks: packed ordinals of its triggers whose hash isn't alone."""

    def send(batches):
        for b in batches:
            keys = b.column(0).to_numpy()
            row, ordinal, h = [], [], []
            for c in text_chunks(b.column(1)):
                p = parse(c)
                row.append(p.row + c.lo)
                ordinal.append(np.arange(len(p.row)) - p.at[p.row])
                h.append(p.hash)
            if not h:
                continue
            row, ordinal, h = np.concatenate(row).astype(np.uint32), np.concatenate(ordinal).astype(np.uint32), np.concatenate(h)
            _, back, count = np.unique(h, return_inverse=True, return_counts=True)
            many = count[back] > 1
            k, marks = _parts(keys[row[many]], ordinal[many], blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int32()), pa.array(k, pa.int32()), pa.array(marks, pa.binary())], names=["block", "part", "packed"])
            several = np.unique(h[many])
            alone = np.flatnonzero(~many)
            known = dict(_by_block(several, blocks))
            packed, at = [], []
            for k, own in {**{k: alone[:0] for k in known}, **{k: alone[o] for k, o in _by_block(h[alone], blocks)}}.items():
                s = several[known[k]] if k in known else several[:0]
                used, local = np.unique(row[own], return_inverse=True)
                head = np.array([len(s), len(own), len(used)], dtype=np.int64)
                packed.append(head.tobytes() + s.tobytes() + h[own].tobytes() + keys[used].tobytes() + local.astype(np.uint32).tobytes() + ordinal[own].tobytes())
                at.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.nulls(len(at), pa.int32()), pa.array(packed, pa.binary())], names=["block", "part", "packed"])

    def find(batches):
        several, h, key, ordinal = [], [], [], []
        for b in batches:
            passed = b.column(0).is_null()
            if pa.compute.any(passed).as_py():
                yield pa.RecordBatch.from_arrays([b.column(1).filter(passed), b.column(2).filter(passed)], names=["part", "packed"])
            for x in b.column(2).filter(pa.compute.invert(passed)):
                raw = x.as_buffer()
                s, n, u = (int(v) for v in np.frombuffer(raw, np.int64, 3))
                several.append(np.frombuffer(raw, U64, s, 24))
                h.append(np.frombuffer(raw, U64, n, 24 + 8 * s))
                own = np.frombuffer(raw, np.int64, u, 24 + 8 * (s + n))
                key.append(own[np.frombuffer(raw, np.uint32, n, 24 + 8 * (s + n + u))])
                ordinal.append(np.frombuffer(raw, np.uint32, n, 24 + 8 * (s + n + u) + 4 * n))
        if not sum(map(len, h)):
            return
        several, h, key, ordinal = (np.concatenate(x) for x in (several, h, key, ordinal))
        several = np.unique(several)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        twice = np.append(same, False) | np.append(False, same)
        if len(several):
            twice |= several[np.minimum(np.searchsorted(several, s), len(several) - 1)] == s
        k, marks = _parts(key[order[twice]], ordinal[order[twice]], blocks)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(marks, pa.binary())], names=["part", "packed"])

    sent = rows.select("key", "text").mapInArrow(lean(send), "block int, part int, packed binary")
    dealt = sent.withColumn("deal", F.coalesce("block", "part")).repartitionById(blocks, "deal").select("block", "part", "packed")
    return by_key(dealt.mapInArrow(lean(find), "part int, packed binary"), blocks, "marks")


_HEAD = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("start", "<i8"), ("size", "<i8")])


def _firsts(head: np.ndarray, content: np.ndarray, start: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Which phrases are the first with their content, and which are repeats of an earlier one."""
    order = np.lexsort((head[start], head["key"], head["doc"], content))
    new = np.append(True, content[order][1:] != content[order][:-1])
    first_of = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.zeros(len(head), dtype=bool)
    first[order[new]] = True
    repeat = np.zeros(len(head), dtype=bool)
    repeat[order] = (head["key"][order] != head["key"][first_of]) | (head[start][order] != head[start][first_of])
    return first, repeat & ~first


def _spans(key: np.ndarray, start: np.ndarray, end: np.ndarray, blocks: int):
    return _parts(key, np.stack([start, end], axis=1).astype("<i8"), blocks)


def _suffix_ranks(data: np.ndarray) -> np.ndarray:
    """Equal values for equal strings of LENGTH bytes, in lexical order, by prefix doubling."""
    padded = np.concatenate([data, np.zeros(LENGTH, dtype=np.uint8)]).astype(U64)
    n = len(data)
    rank = np.zeros(n + LENGTH - 7, dtype=U64)
    for k in range(8):
        rank = (rank << U64(8)) | padded[k : k + len(rank)]
    rank = np.unique(rank, return_inverse=True)[1].astype(U64)
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        both = (rank[: len(rank) - step] << U64(32)) | rank[step:]
        rank = np.unique(both, return_inverse=True)[1].astype(U64)
        depth += step
    return rank[:n]


def repeated_spans(rows: DataFrame, blocks: int) -> DataFrame:
    """key and packed (start, end) of spans to remove; rows bring their marks."""

    def send(batches):
        for b in batches:
            keys, docs = b.column(0).to_numpy(), b.column(1).fill_null(-(1 << 63)).to_numpy()
            heads, parts = [], []
            for c in text_chunks(b.column(2)):
                p = Parse(c)
                marked = np.zeros(len(p.row), dtype=bool)
                for i in range(len(c)):
                    marked[p.at[i] + np.frombuffer(b.column(3)[c.lo + i].as_buffer(), np.uint32).astype(np.int64)] = True
                at = np.flatnonzero(marked)
                head = np.zeros(len(at), dtype=_HEAD)
                head["hash"], head["doc"], head["key"] = p.hash[at], docs[p.row[at] + c.lo], keys[p.row[at] + c.lo]
                head["start"], head["size"] = p.lo[at] - c.offsets[p.row[at]], p.hi[at] - p.lo[at] + LENGTH
                content = text_hash(c.data, p.lo[at], p.hi[at] + LENGTH)
                heads.append((head, content, c.data, p.lo[at]))
            if not heads or not sum(len(h[0]) for h in heads):
                continue
            head, content = np.concatenate([h[0] for h in heads]), np.concatenate([h[1] for h in heads])
            first, repeat = _firsts(head, content)
            k, spans = _spans(head["key"][repeat], head["start"][repeat], (head["start"] + head["size"])[repeat], blocks)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int32()), pa.array(k, pa.int32()), pa.array(spans, pa.binary())], names=["block", "part", "packed"])
            which = np.repeat(np.arange(len(heads)), [len(h[0]) for h in heads])
            lo = np.concatenate([h[3] for h in heads])
            keep = np.flatnonzero(first)
            at = []
            for k, own in _by_block(head["hash"][keep], blocks):
                own = keep[own]
                for x in range(0, len(own), 4096):
                    some = own[x : x + 4096]
                    parts.append(np.int64(len(some)).tobytes() + head[some].tobytes() + b"".join(heads[which[j]][2][lo[j] : lo[j] + head["size"][j]].tobytes() for j in some))
                    at.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.nulls(len(at), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part", "packed"])

    def find(batches):
        heads, texts, contents = [], [], []
        for b in batches:
            passed = b.column(0).is_null()
            if pa.compute.any(passed).as_py():
                yield pa.RecordBatch.from_arrays([b.column(1).filter(passed), b.column(2).filter(passed)], names=["part", "packed"])
            for x in b.column(2).filter(pa.compute.invert(passed)):
                raw = x.as_buffer()
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                heads.append(np.frombuffer(raw, _HEAD, n, 8))
                texts.append(np.frombuffer(raw, np.uint8, offset=8 + n * _HEAD.itemsize).copy())
                edge = np.append(0, np.cumsum(heads[-1]["size"]))
                contents.append(text_hash(texts[-1], edge[:-1], edge[1:]))
        if not heads:
            return
        head, data, content = np.concatenate(heads), np.concatenate(texts), np.concatenate(contents)
        del heads, texts, contents
        begin = np.concatenate([[0], np.cumsum(head["size"])])
        first, repeat = _firsts(head, content)
        out = [(head["key"][repeat], head["start"][repeat], (head["start"] + head["size"])[repeat])]

        # The dictionary: distinct phrases whose trigger has others.
        at = np.flatnonzero(first)
        _, back, count = np.unique(head["hash"][at], return_inverse=True, return_counts=True)
        at = at[count[back] > 1]
        at = at[np.argsort(head["hash"][at], kind="stable")]
        begin_of, lo = np.append(0, np.cumsum(head["size"][at])), 0
        while lo < len(at):
            hi = int(np.searchsorted(begin_of, begin_of[lo] + (1 << 20), "right")) - 1
            hi = max(hi, lo + 1)
            while hi < len(at) and head["hash"][at[hi]] == head["hash"][at[hi - 1]]:
                hi += 1
            own = at[lo:hi]
            size = head["size"][own].astype(np.int64)
            edge = np.append(0, np.cumsum(size))
            joined = np.concatenate([data[begin[j] : begin[j + 1]] for j in own])
            rank = _suffix_ranks(joined)
            phrase = np.repeat(np.arange(len(own)), size)
            place = np.arange(len(joined)) - edge[phrase]
            whole = np.flatnonzero(place + LENGTH <= size[phrase])
            phrase, place, rank = phrase[whole], place[whole], rank[whole]
            pos = head["start"][own][phrase] + place
            doc, key = head["doc"][own][phrase], head["key"][own][phrase]
            order = np.lexsort((pos, key, doc, rank))
            r = rank[order]
            later = np.append(False, r[1:] == r[:-1])
            group = np.maximum.accumulate(np.where(later, 0, np.arange(len(r))))
            later &= (key[order] != key[order][group]) | (pos[order] != pos[order][group])
            dup = np.zeros(len(r), dtype=bool)
            dup[order] = later
            d = np.flatnonzero(dup)
            if len(d):
                cut = np.flatnonzero(np.append(True, (phrase[d][1:] != phrase[d][:-1]) | (place[d][1:] != place[d][:-1] + 1)))
                last = np.append(cut[1:], len(d)) - 1
                out.append((key[d[cut]], pos[d[cut]], pos[d[last]] + LENGTH))
            lo = hi
        k, spans = _spans(*(np.concatenate(x) for x in zip(*out, strict=True)), blocks)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(spans, pa.binary())], names=["part", "packed"])

    sent = rows.select("key", "id", "text", "marks").mapInArrow(lean(send), "block int, part int, packed binary")
    dealt = sent.withColumn("deal", F.coalesce("block", "part")).repartitionById(blocks, "deal").select("block", "part", "packed")
    return by_key(dealt.mapInArrow(lean(find), "part int, packed binary"), blocks, "spans")


def union(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) merged where they overlap or touch, ascending."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    cut = np.flatnonzero(new)
    return np.stack([spans[cut, 0], reach[np.append(cut[1:], len(spans)) - 1]], axis=1)


def removed_spans(docs: DataFrame) -> DataFrame:
    """id, text and spans (packed, null: none) of each row."""
    batch_rows(docs.sparkSession, 10_000)  # phrases that repeat in a batch are sent once
    blocks = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text"))  # all uses read the same columns, so that the text is exchanged once
    marks = repeated_triggers(rows, blocks)
    spans = repeated_spans(rows.join(marks, "key"), blocks)
    return rows.join(spans, "key", "left").select("id", "text", "spans")


def removal(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: what is removed and a digest of what is kept."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                raw = text.as_buffer().to_pybytes()
                runs = union(np.frombuffer(spans.as_buffer(), "<i8").reshape(-1, 2)) if spans.is_valid else np.zeros((0, 2), dtype=np.int64)
                sha, at = hashlib.sha256(), 0
                for a, e in runs.tolist():
                    sha.update(raw[at:a])
                    at = e
                sha.update(raw[at:])
                for k, v in enumerate((len(raw), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), sha.hexdigest())):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(docs).mapInArrow(run, SCHEMA)
