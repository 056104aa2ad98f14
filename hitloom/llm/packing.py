"""Packing documents into fixed windows by non-negative least squares (operator 7).

Documents are tokenized, given an end id and cut at multiples of the window,
so that a whole window is a sequence of its own and only tails remain to be
combined.  Tails fall into bins of length; the driver holds just the
histogram of bins.  All combinations of at most three bins that fill a window
are enumerated; non-negative least squares finds how often to use each; the
counts are rounded down to what the histogram has, and what is left over is
packed greedily, largest bin first with the best fitting rest, in runs of
equal sequences.  Each run gives a piece its sequence by its rank in its bin.

Nothing but the histogram (window / bin_width rows) and the counts of shards
leaves the executors, and no key owns a task: ranks are made in shards of a
bin.

Defined cases: a null text is empty, and an empty text is its end id alone;
a null id is passed on; repeated rows are packed each on their own, and equal
pieces in any order among their places; very long texts are encoded as wholes
and cut into as many pieces as they need; other columns are ignored; an empty
table gives no rows; an added token's string in a text is that token, as the
tokenizers library has it by default.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from .common import batch_rows, lean, partitions, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Texts with longer runs of blanks or of anything else go to the tokenizers library: the quick encoder's splitting
#: pattern recurses over blanks, and its merging takes quadratic time over one long piece.
LONG_RUN = r"\s{300}|\S{1000}"
_ENCODERS: dict = {}


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer file, as the tokenizers library gives them by default.

    The library itself takes any text.  Where the file is a plain byte-level
    BPE whose ids follow the order of its merges, ordinary texts are encoded
    from the same file by an equal, quicker encoder.
    """

    def __init__(self, path: str, pattern: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.quick = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and spec.get("normalizer") is None:
            import tiktoken

            byte_of = _bytes_of()
            added = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
            self.quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, texts: pa.Array):
        """Ids of each text of a string array (null: empty)."""
        texts = texts.fill_null("")
        long_ = pa.compute.match_substring_regex(texts, LONG_RUN).to_pylist()
        for text, hard in zip(texts, long_, strict=True):
            t = text.as_py()
            yield self.library.encode(t, add_special_tokens=False).ids if hard or self.quick is None else self.quick.encode(t, allowed_special="all")


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, pattern)
    return _ENCODERS[path]


def cut_pieces(docs: DataFrame, path: str, pattern: str, window: int, end_id: int) -> DataFrame:
    """Tokenized documents cut at multiples of the window."""

    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, own in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                ids = np.array([*own, end_id], dtype="<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    for k, v in enumerate((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES)


def combinations(bins: int) -> np.ndarray:
    """Columns of bin counts: one, two or three bins that fill all of a window."""
    found = [(bins,)]
    found += [(a, bins - a) for a in range(1, bins // 2 + 1)]
    found += [(a, b, bins - a - b) for a in range(1, bins // 3 + 1) for b in range(a, (bins - a) // 2 + 1)]
    out = np.zeros((bins + 1, len(found)))
    for k, combo in enumerate(found):
        for x in combo:
            out[x, k] += 1
    return out


def nnls(a: np.ndarray, y: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative least squares by an active set."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    scale = max(1.0, float(np.abs(y).max(initial=0)))
    for _ in range(rounds or 4 * a.shape[0]):
        gain = a.T @ (y - a @ x)
        gain[passive] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] <= 1e-9 * scale:
            break
        passive[k] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], y, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            passive[at[(x[at] <= 1e-12 * scale)]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Runs (bins of one sequence, number of such sequences) that use up the histogram."""
    left = histogram.astype(np.int64).copy()
    bins = len(left) - 1
    runs = []
    table = combinations(bins)
    guess = nnls(table, left.astype(float))
    for k in np.argsort(-guess, kind="stable"):
        if guess[k] < 0.5:
            break
        used = table[:, k].astype(np.int64)
        n = min(int(round(guess[k])), int(np.min(left[used > 0] // used[used > 0])))
        if n > 0:
            left -= n * used
            runs.append((tuple(int(b) for b in np.repeat(np.arange(bins + 1), used))[::-1], n))
    while left.any():
        combo, room, rest = [], bins, left.copy()
        while room > 0:
            fit = np.flatnonzero(rest[: room + 1])
            if not len(fit):
                break
            combo.append(int(fit[-1]))
            rest[fit[-1]] -= 1
            room -= int(fit[-1])
        used = np.bincount(combo, minlength=bins + 1)
        n = int(np.min(left[used > 0] // used[used > 0]))
        left -= n * used
        runs.append((tuple(combo), n))
    return runs


def pack(docs: DataFrame, path: str, pattern: str, window: int = 2048, end_id: int = 1, bin_width: int = 16) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    spark = docs.sparkSession
    batch_rows(spark, 2500)
    bins = window // bin_width
    pieces = written(cut_pieces(docs, path, pattern, window, end_id), "pieces")
    shards = partitions(spark)
    ranked = pieces.withColumn("bin", F.ceil(F.col("length") / bin_width).cast("int")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).cast("int"))
    counts = ranked.groupBy("bin", "shard").agg(F.count("*").alias("n"))
    histogram = np.zeros(bins + 1, dtype=np.int64)
    for b, n in counts.groupBy("bin").agg(F.sum("n")).collect():
        histogram[b] = n
    slots: dict[int, list[tuple[int, int, int]]] = {b: [] for b in range(1, bins + 1)}
    taken, first = [0] * (bins + 1), 0
    for combo, n in plan(histogram):
        for slot, b in enumerate(combo):
            slots[b].append((taken[b], first, slot))
            taken[b] += n
        first += n
    arrays = {b: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for b, v in slots.items() if v}

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("bin").orderBy("shard")) - F.col("n")).drop("n")
    own = Window.partitionBy("bin", "shard").orderBy("doc_id", "start", "ids_crc32")
    ranked = ranked.withColumn("rank", F.row_number().over(own) - 1).join(before, ["bin", "shard"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        for b in batches:
            bin_of, rank = b.column(0).to_numpy(), b.column(1).to_numpy()
            seq, slot = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for k in np.unique(bin_of):
                at = np.flatnonzero(bin_of == k)
                lo, base, s = arrays[int(k)]
                run = np.searchsorted(lo, rank[at], "right") - 1
                seq[at], slot[at] = base[run] + rank[at] - lo[run], s[run]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(slot)], names=[*names, "sequence_id", "slot"])

    placed = ranked.select("bin", F.col("rank").cast("long").alias("rank"), *names).mapInArrow(place, PIECES + ", sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).drop("slot")
