"""Stupid-backoff language-model scores of all documents (operator 3).

The model is the corpus itself, with n-grams of up to ``order`` words.  A word
w after the words before it scores ``c(v.. w) / c(v..)`` for the longest n-gram
ending at it that the tables hold, times ``ALPHA`` for every word of context
given up; with no context left it scores ``c(w) / N``.  A document's score is
the sum of the logarithms.  Tables hold all words and the longer n-grams that
occur ``min_count`` times or more: the default of 1 keeps every n-gram, so that
words of the corpus itself never back off; larger values prune the model as is
usual for large ones.  ``n_backoff`` counts the words that gave up context,
``n_single`` those whose n-gram of full order occurs nowhere else.

In relational terms: n-grams are exploded and counted by batch, so that even
the most frequent one travels at most once for each batch; the partial counts
are partitioned by hash and added up to the count tables; these are joined to
the batches' n-grams where they meet, in the same partition; and the totals go
back to the batch, whose words are scored and summed by document.  Lists travel
packed, sorted by hash, so a batch's totals need no hashes: in order of
partitions they are in the order of its own distinct n-grams.  The number of
partitions follows the input's size.

A batch is known by a digest of its content.  Its n-grams are made in one scan
and scored in another, which have to cut the table alike: ``scanned`` gives a
plan that does, also for tasks that are repeated.

Defined cases: a null text is empty; an empty text scores 0 with no words; a
null id is passed on; repeated rows count and score each; texts of any length
are whole; the case of A-Z is ignored; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, batch_rows, lean, mix, partitions, scanned, text_chunks, word_hashes

ALPHA = 0.4
BATCH_ROWS, BATCH_TEXT = 4_000, 8 << 20
BLOCK_INPUT = 16 << 20  # bytes of stored input for each hash partition, at most
SCHEMA = "doc_id long, n_words long, n_backoff long, n_single long, log_score double"
PART = "batch long, block int, packed binary"


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column and their row offsets."""
    parts, counts = [np.zeros(0, dtype=U64)], [np.zeros(1, dtype=np.int64)]
    for c in text_chunks(column):
        w, at = word_hashes(c, lower=True)
        parts.append(w)
        counts.append(np.diff(at))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def _grams(w: np.ndarray, at: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n the places at which an n-gram of one row ends, and the hashes of all, n by n."""
    place = np.arange(len(w)) - np.repeat(at[:-1], np.diff(at))
    ends, out = [], []
    so_far = np.zeros(len(w), dtype=U64)
    for n in range(1, order + 1):
        shifted = np.zeros(len(w), dtype=U64)
        shifted[n - 1 :] = w[: max(0, len(w) - n + 1)]
        so_far = mix(so_far ^ shifted) + U64(n)  # of the last n words
        ends.append(np.flatnonzero(place >= n - 1))
        out.append(mix(so_far[ends[-1]]))
    return ends, np.concatenate(out)


_ZSTD = pa.Codec("zstd", 1)


def _squeezed(raw: bytes) -> bytes:
    return np.int64(len(raw)).tobytes() + _ZSTD.compress(raw, asbytes=True)


def _plain(squeezed) -> bytes:
    """The bytes of a buffer or bytes that ``_squeezed`` made."""
    squeezed = memoryview(squeezed)
    return _ZSTD.decompress(squeezed[8:], int(np.frombuffer(squeezed[:8], np.int64)[0]), asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """64-bit values as eight planes of bytes, of which those of small values compress to nothing."""
    return _squeezed(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _values(squeezed) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_plain(squeezed), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _content(batch: pa.RecordBatch) -> tuple[int, bytes]:
    """A batch of ids and texts as bytes, and their digest."""
    ids, text = batch.column(0), batch.column(1).fill_null("").cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = b"" if data is None else memoryview(data)[ends[0] : ends[-1]]
    packed = b"".join([
        np.int64(len(ids)).tobytes(),
        ids.fill_null(0).to_numpy().tobytes(),
        np.asarray(ids.is_null().to_numpy(zero_copy_only=False), dtype=np.int64).tobytes(),
        (ends - ends[0]).tobytes(),
        raw,
    ])
    return int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True), packed


def _read(packed: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids, which of them are null, and texts."""
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    ids, null = np.frombuffer(packed, np.int64, 2 * n, 8).reshape(2, n)
    at = 8 + 16 * n
    text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(packed[at : at + 8 * n + 8]), pa.py_buffer(packed[at + 8 * n + 8 :]))
    return ids, null.astype(bool), text


def _rows(batch, block, packed) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch, pa.int64()), pa.array(block, pa.int32()), pa.array(packed, pa.binary())], names=["batch", "block", "packed"])


def word_total(texts: DataFrame) -> int:
    """The number of words of all texts."""

    def count(batches):
        n = sum(int(c.words()[2][-1]) for b in batches for c in text_chunks(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return texts.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def _scores(counts: list[np.ndarray], at: np.ndarray, total: int, min_count: int) -> tuple[np.ndarray, ...]:
    """Words, backoffs, single n-grams and score of each row, from the count of the n-gram of each order ending at each word."""
    order, n_words = len(counts), np.diff(at)
    row = np.repeat(np.arange(len(n_words)), n_words)
    have = np.minimum(np.arange(len(row)) - at[row] + 1, order)  # words of the longest n-gram that the text allows
    level = np.ones(len(row), dtype=np.int64)
    value = np.log(np.maximum(counts[0], 1)) - math.log(max(total, 1))
    for n in range(2, order + 1):
        hit = np.flatnonzero((have >= n) & (counts[n - 1] >= min_count))
        value[hit] = np.log(counts[n - 1][hit]) - np.log(counts[n - 2][hit - 1])
        level[hit] = n
    value += (have - level) * math.log(ALPHA)
    add = lambda x: np.bincount(row, x, len(n_words))
    return n_words, add(have > level).astype(np.int64), add((have == order) & (counts[-1] == 1)).astype(np.int64), add(value)


def scores(docs: DataFrame, min_count: int = 1, order: int = 3) -> DataFrame:
    """One row for each row of docs, as the module says."""
    spark = docs.sparkSession
    batch_rows(spark, BATCH_ROWS, BATCH_TEXT)
    rows, size = scanned(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")))
    blocks = max(partitions(spark), -(-size // BLOCK_INPUT))
    total = word_total(rows.select("text"))

    def explode(batches):
        for b in batches:
            key, _ = _content(b)
            gram, n = np.unique(_grams(*_words(b.column(1)), order)[1], return_counts=True)
            block = ((gram >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)  # ascending, like the hashes
            cuts = np.searchsorted(block, np.arange(blocks + 1))
            some = np.flatnonzero(np.diff(cuts))
            yield _rows([key] * len(some), some, [_planes(np.concatenate([np.diff(gram[lo:hi], prepend=U64(0)), n[lo:hi].astype(U64)])) for lo, hi in zip(cuts[some], cuts[some + 1], strict=True)])

    def count(batches):
        keys, parts = [], []
        for b in batches:
            for key, block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                values = _values(packed.as_buffer())
                with np.errstate(over="ignore"):
                    parts.append((np.cumsum(values[: len(values) // 2]), values[len(values) // 2 :].astype(np.int64)))
                keys.append((key, block))
        if not parts:
            return
        gram, n = (np.concatenate([p[k] for p in parts]) for k in range(2))
        order_ = np.argsort(gram)
        gram = gram[order_]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        table = np.add.reduceat(n[order_], first)  # the count table of this partition
        n[order_] = np.repeat(table, np.diff(np.append(first, len(gram))))
        hi = np.cumsum([len(p[0]) for p in parts])
        for (key, block), lo, end in zip(keys, np.append(0, hi[:-1]), hi, strict=True):
            yield _rows([key], [block], [_planes(n[lo:end])])

    def bundle(batches):
        for b in batches:
            key, packed = _content(b)
            yield _rows([key], [-1], [_squeezed(packed)])

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        block = right["block"].to_numpy()
        packed = right["packed"]
        first = np.unique(block, return_index=True)[1]  # equal batches bring equal totals
        totals = np.concatenate([np.zeros(0, dtype=U64), *(_values(packed[int(i)].as_buffer()) for i in first)]).astype(np.int64)
        ids, null, text = _read(_plain(left["packed"][0].as_buffer()))
        w, at = _words(text)
        ends, grams = _grams(w, at, order)
        known, place = np.unique(grams, return_inverse=True)
        if len(known) != len(totals):
            raise RuntimeError("a batch was read otherwise when its n-grams were counted")
        found, counts, lo = totals[place], [], 0
        for e in ends:
            c = np.zeros(len(w), dtype=np.int64)
            c[e] = found[lo : lo + len(e)]
            counts.append(c)
            lo += len(e)
        n_words, late, single, score = _scores(counts, at, total, min_count)
        out = pa.table({"doc_id": pa.array(ids, mask=null), "n_words": n_words, "n_backoff": late, "n_single": single, "log_score": score})
        return pa.concat_tables([out] * left.num_rows)

    sent = rows.mapInArrow(lean(explode), PART)
    counted = sent.repartitionById(blocks, "block").mapInArrow(lean(count), PART)
    texts = rows.mapInArrow(lean(bundle), PART)
    return texts.groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(gather, SCHEMA)
