"""Periodic run detection over words (operator 12).

A run is a stretch of consecutive words with smallest period q, at least
``max(least, times * q)`` words long, that no neighbouring word extends.  For
each text a stack is kept from right to left that gives the longest Lyndon
word beginning at each place, once under the order of the words and once under
its reverse (a text's end is smallest in both); each run has a root among
these Lyndon words, so their lengths are the only periods to try.  Suffixes
are compared, and runs extended to both sides, by longest common extensions:
binary search over rolling hashes, carried on by a word where the diagonal was
asked before.  What the hashes say is verified on the words: each comparison's
extension, and every run; where a hash has deceived, the stretch is gone
through again without hashes.  There is no suffix array.

Words are numbered in each batch by their bytes, exactly.  A run of at least
six words that is four periods long repeats each of its five-word windows
within the text; so only stretches of words under windows that occur twice go
to the stack, and each holds its runs whole (``least`` and ``times`` below
these switch the sieve off).  Each text is judged on its own, where it is
read: there is no shuffle, and a hot source or key moves nothing.

Defined cases: a null or empty text has no words and no runs; a null id is
passed on; repeated rows give repeated rows; a text of any length is judged as
a whole, in memory in proportion to its words and time to the words under the
sieve; ties go to the smallest start, then period; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import U64, batch_rows, lean, mix, struct_batch

LEAST, TIMES = 6, 4
WINDOW = 5
#: two prime moduli below 2**31 with a base each, fixed
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (np.uint64(1103515245), np.uint64(1566083941))


class Hashes:
    """Prefix sums of word hashes times powers of a base, under both moduli: equal stretches differ by a power only."""

    def __init__(self, words: np.ndarray):
        self.prefix, self.power = [], []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            power = np.array([1, base], dtype=U64)
            while len(power) <= len(words):
                power = np.concatenate([power, power * (power[-1] * base % prime) % prime])
            power = power[: len(words) + 1]
            sums = np.cumsum(mix(words.astype(U64)) % prime * power[:-1] % prime) % prime  # below 2**63 for 2**32 words
            self.prefix.append(np.concatenate([np.zeros(1, dtype=U64), sums]))
            self.power.append(power)

    def cut(self, a: int, b: int) -> list[list[int]]:
        """Prefix hashes of a stretch under both moduli, and the powers."""
        return [*(x[a : b + 1].tolist() for x in self.prefix), *(x[: b - a + 1].tolist() for x in self.power)]

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of the given lengths from i and j have equal hashes."""
        out = np.ones(len(i), dtype=bool)
        for h, power, prime in zip(self.prefix, self.power, _PRIMES, strict=True):
            a = (h[i + length] + prime - h[i]) % prime * power[j - i] % prime
            b = (h[j + length] + prime - h[j]) % prime
            out &= a == b
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Longest common extension to the right of i and j (i < j), before end."""
        low, high = np.zeros(len(i), dtype=np.int64), end - j
        while (low < high).any():
            half = (low + high + 1) // 2
            fits = self.same(i, j, half)
            low, high = np.where(fits, half, low), np.where(fits, high, half - 1)
        return low

    def behind(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Longest common extension to the left of places i and j (i < j), neither included, from begin on."""
        low, high = np.zeros(len(i), dtype=np.int64), i - begin
        while (low < high).any():
            half = (low + high + 1) // 2
            fits = self.same(i - half, j - half, half)
            low, high = np.where(fits, half, low), np.where(fits, high, half - 1)
        return low


def _extension(words: list[int], hashes: list[list[int]] | None):
    """A function for the longest common extension of two places, i < j.

    Equal stretches have equal hashes, so what the search finds is never too
    short; that it isn't too long is seen from the words themselves.
    """
    n = len(words)

    def direct(i: int, j: int) -> int:
        k = 0
        while j + k < n and words[i + k] == words[j + k]:
            k += 1
        return k

    if hashes is None:
        return direct
    raw = np.array(words, dtype=np.int64).tobytes()
    h0, h1, w0, w1 = hashes
    p0, p1 = map(int, _PRIMES)

    def by_hash(i: int, j: int) -> int:
        if words[i] != words[j]:
            return 0
        low, high = 1, n - j
        a, b, step = w0[j - i], w1[j - i], 2
        while low < high:  # doubling first, then halving
            k = min(high, step) if step else (low + high + 1) // 2
            if ((h0[i + k] - h0[i]) * a - h0[j + k] + h0[j]) % p0 == 0 and ((h1[i + k] - h1[i]) * b - h1[j + k] + h1[j]) % p1 == 0:
                low = k
                step *= 2
            else:
                high = k - 1
                step = 0
        return low if raw[8 * i : 8 * (i + low)] == raw[8 * j : 8 * (j + low)] else direct(i, j)

    return by_hash


def lyndon_lengths(words: list[int], hashes: list[list[int]] | None) -> tuple[list[int], list[int]]:
    """Length of the longest Lyndon word at each place, under the order of the numbers and under its reverse.

    Both stacks are threaded through the arrays of next smaller suffixes.  The
    extension asked last on a diagonal is kept: one word to the left it is
    longer by one.
    """
    n = len(words)
    extension = _extension(words, hashes)
    up, down = [n] * (n + 1), [n] * (n + 1)
    known: dict[int, tuple[int, int]] = {}

    def common(i: int, j: int) -> int:
        if words[i] != words[j]:
            return 0
        at, length = known.get(j - i, (-1, 0))
        if at != i:
            length = length + 1 if at == i + 1 else extension(i, j)
            known[j - i] = (i, length)
        return length

    for i in range(n - 1, -1, -1):
        x = words[i]
        j = i + 1
        while j < n:
            y = words[j]
            if x == y:
                k = common(i, j)
                if j + k >= n or words[i + k] > words[j + k]:
                    break
            elif x > y:
                break
            j = up[j]
        up[i] = j
        j = i + 1
        while j < n:
            y = words[j]
            if x == y:
                k = common(i, j)
                if j + k >= n or words[i + k] < words[j + k]:
                    break
            elif x < y:
                break
            j = down[j]
        down[i] = j
    return [j - i for i, j in enumerate(up[:n])], [j - i for i, j in enumerate(down[:n])]


def _verified(words: np.ndarray, runs: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> bool:
    """Whether all runs are periodic word by word, and can't be extended within their stretches."""
    start, end, period = runs[:, 0], runs[:, 0] + runs[:, 1], runs[:, 2]
    size = end - start - period
    first = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    if (words[first] != words[first + np.repeat(period, size)]).any():
        return False
    left, right = start > begin, end < stop
    return not ((words[start[left] - 1] == words[start[left] - 1 + period[left]]).any() or (words[end[right]] == words[end[right] - period[right]]).any())


def find_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES, hashed: bool = True) -> np.ndarray:
    """start, length and period of all runs of the given stretches (apart from each other, in order) of a sequence of word numbers."""
    use = ends - starts >= max(2, least)
    starts, ends = starts[use], ends[use]
    at, period = [], []
    hashes = Hashes(words) if hashed and len(starts) else None
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        for found in lyndon_lengths(words[a:b].tolist(), hashes and hashes.cut(a, b)):
            p = np.array(found, dtype=np.int64)
            fits = np.flatnonzero(np.maximum(least, times * p) <= b - a)
            at.append(a + fits)
            period.append(p[fits])
    if not at:
        return np.zeros((0, 3), dtype=np.int64)
    at, period = np.concatenate(at), np.concatenate(period)
    own = np.searchsorted(starts, at, "right") - 1
    if hashes is not None:
        right = hashes.ahead(at, at + period, ends[own])
        left = hashes.behind(at, at + period, starts[own])
    else:
        right, left = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for k, (i, p, a, b) in enumerate(zip(at.tolist(), period.tolist(), starts[own].tolist(), ends[own].tolist(), strict=True)):
            right[k] = _extension(words[i:b].tolist(), None)(0, p)
            left[k] = _extension(words[a : i + p][::-1].tolist(), None)(0, p)
    start, length = at - left, left + period + right
    long_ = length >= np.maximum(least, np.maximum(2, times) * period)
    runs, first = np.unique(np.stack([start, period, length], axis=1)[long_], axis=0, return_index=True)
    runs = runs[:, [0, 2, 1]]
    own = own[long_][first]
    if hashed and not _verified(words, runs, starts[own], ends[own]):
        return find_runs(words, starts, ends, least, times, hashed=False)
    return runs


def stretches(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches under windows of five words that occur twice or more in their row (offsets ``at``).

    Windows are compared by hash: a collision lets more through, never less.
    """
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = mix(row[:n].astype(U64))
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            key = mix(key * U64(31) + words[k : k + n].astype(U64))
    inside = row[:n] == row[WINDOW - 1 :]
    place = np.flatnonzero(inside)
    order = np.argsort(key[place], kind="stable")
    sorted_ = key[place][order]
    same = sorted_[1:] == sorted_[:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    mark = np.zeros(n + 2, dtype=np.int8)
    mark[1 + place[order[twice]]] = 1
    edge = np.diff(mark)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends + WINDOW - 1  # rows are apart: a row's last four words begin no window


def runs_of_rows(words: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all rows of a batch, by row, start and period, and their offsets."""
    if times >= TIMES and least >= LEAST:
        starts, ends = stretches(words, at)
    else:
        starts, ends = at[:-1], at[1:]
    size = ends - starts
    own = np.cumsum(size) - size  # places among the words of all stretches
    under = np.repeat(starts - own, size) + np.arange(size.sum())
    runs = find_runs(words[under], own, own + size, least, times)
    runs[:, 0] = under[runs[:, 0]]
    row = np.searchsorted(at, runs[:, 0], "right") - 1
    runs[:, 0] -= at[row]
    return runs, np.searchsorted(row, np.arange(len(at)))


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their numbers end to end, and the offsets."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    split = [t.split() for t in texts]  # at 0x20 and 0x09-0x0D
    at = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(at[-1]))
    return split, ids, at


def _groups(column: pa.Array, limit: int = 2 << 20):
    """Texts of a column as bytes, about ``limit`` bytes at a time, with the place of the first."""
    group, size, first = [], 0, 0
    for k, t in enumerate(column.cast(pa.large_binary())):
        text = t.as_py() or b""
        group.append(text)
        size += len(text)
        if size >= limit:
            yield first, group
            group, size, first = [], 0, k + 1
    if group:
        yield first, group


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, start, length and period of each run: words from the text's first, numbered from 0."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "period")])

    def run(batches):
        for b in batches:
            for first, group in _groups(b.column(1)):
                _, ids, at = _numbered(group)
                found, cut = runs_of_rows(ids, at, least, times)
                own = b.column(0).take(pa.array(first + np.repeat(np.arange(len(group)), np.diff(cut))))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(found[:, k]) for k in range(3))], schema=schema)

    batch_rows(docs.sparkSession, 4000, 16 << 20)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, start long, length long, period long")


def _kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds beyond its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:n]) == 0


COLLAPSED = "doc_id long, text string, n_words long, runs array<struct<start: long, length: long, period: long>>"


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, text with each run cut to its first period (words joined by one blank), n_words of the whole text, and its runs."""
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("runs", pa.list_(item))])

    def run(batches):
        for b in batches:
            for first, group in _groups(b.column(1)):
                split, ids, at = _numbered(group)
                found, cut = runs_of_rows(ids, at, least, times)
                texts = []
                for k, words in enumerate(split):
                    if cut[k] < cut[k + 1]:
                        words = [words[i] for i in np.flatnonzero(_kept(len(words), found[cut[k] : cut[k + 1]]))]
                    texts.append(b" ".join(words))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], fields=list(item)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(group)), pc.cast(pa.array(texts, pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True)), pa.array(np.diff(at)), lists], schema=schema)

    batch_rows(docs.sparkSession, 4000, 16 << 20)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), COLLAPSED)


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_DIGESTS = pa.schema([*((n, pa.int64()) for n in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def digests(collapsed: DataFrame) -> DataFrame:
    """Per row of ``collapse``: number of runs, the one with most periods, and digests of all runs and of the text that is left."""

    def run(batches):
        for b in batches:
            rows = []
            lists = b.column("runs")
            values = np.stack([lists.values.field(k).to_numpy() for k in range(3)], axis=1)
            cut = lists.offsets.to_numpy()
            for k, text in enumerate(b.column("text").cast(pa.large_binary())):
                own = values[cut[k] : cut[k + 1]].tolist()
                best = None
                for r in own:
                    if best is None or r[1] * best[2] > best[1] * r[2]:  # in order of start and period
                        best = r
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in own)
                rows.append((len(own), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.as_py()).hexdigest()))
            names = _DIGESTS.names[1:]
            yield struct_batch(_DIGESTS, doc_id=b.column("doc_id"), **{n: [r[i] for r in rows] for i, n in enumerate(names)})

    return collapsed.mapInArrow(run, DIGESTS)
