"""Near-duplicate passages by compact windows (operator 8).

Tokens are five-word shingles.  Under each of ``HASHES`` hash functions the
nodes of the Cartesian tree over a text's token hashes stand for compact
windows (left, place, right): all strings of tokens inside that hold the place
share its hash as their signature.  Only nodes spanning at least a passage of
``MIN_WORDS`` words count; both ends are cut at a passage's length from the
place, as longer strings are unions of such ones.

1. Windows' signatures go, packed, to hash blocks, which report those that
   occur more than once to their documents.
2. Documents join the reported intervals of all hash functions: a window is
   kept if a passage in it lies in reported windows of at least ``AGREE``
   functions.  The kept windows of the first ``CARRY`` functions are sent with
   their tokens to the blocks of their signatures.
3. There each window is compared with the earlier ones of its signature, in
   corpus order, that share a rare enough token with it, at whatever place:
   the words of the longest string around the shared token that has an exact
   Jaccard similarity of 0.75 or more with one of the other window are repeats.
   Windows that share too few tokens with all others of their signature, as
   those about a common line do, are left out before.

Later copies of whole texts are found first, by a 128-bit digest, and take no
part in this.  Spans of repeats go back to their documents; the first of near-duplicate
passages stays.  Two passages of similarity s are found if at least AGREE of
HASHES hash functions agree on them; all but AGREE - 1 of the functions carry
windows, so that one that agrees always does.  Equal passages are always found;
a string of MIN_WORDS words is missed with probability (1 - s)**3, which is
0.016 at s = 0.75 (longer passages have many such strings).  The rule for which windows are compared is the same at all sizes and loses no
similar string, as ``_Lists`` proves.  A window is compared with the earlier
ones of its lists until its whole extent is explained or none is left that
shares a token outside of what is explained.  Equal windows are one.

Defined cases: a null text is empty; texts under MIN_WORDS words stay whole;
a null id is smaller than all others; rows with equal id and text are one
document reported as often; the case of A-Z is ignored; an empty table gives
no rows; other columns are ignored or, in ``cut_repeats``, passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .common import U64, Chunk, batch_rows, gram_hashes, lean, mix, partitions, span_hash, text_chunks, value_prefix, word_hashes, written
from .suffix_dedup import _by_block, _firsts, _spans, by_key, repeated_triggers, union

WORDS = 5
MIN_WORDS = 50
TOKENS = MIN_WORDS - WORDS + 1
SIDE = TOKENS - 1
WIDTH = 2 * SIDE + 1
HASHES, AGREE, CARRY = 3, 1, 3
NUM, DEN = 3, 4
_LOW = U64(0xFFFFFFFF)
SCHEMA = "doc_id long, n_words long, n_removed_words long, n_spans long, kept_sha256 string"


class Windows:
    """Compact windows of a chunk: row, hash function, place, extents, signature; and their offsets by row."""

    def __init__(self, chunk: Chunk):
        words, word_at = word_hashes(chunk, lower=True)
        self.tokens, self.token_at = gram_hashes(words, word_at, WORDS)
        found = [self._nodes(k) for k in range(HASHES)]
        row, k, place, lo, hi, sig = (np.concatenate([f[i] for f in found]) for i in range(6))
        order = np.lexsort((place, k, row))
        self.row, self.k, self.place, self.lo, self.hi, self.hash = (x[order] for x in (row, k, place, lo, hi, sig))
        self.at = np.searchsorted(self.row, np.arange(len(chunk) + 1))

    def _nodes(self, k: int):
        none = [np.zeros(0, dtype=np.int64)] * 5 + [np.zeros(0, dtype=U64)]
        n = len(self.tokens)
        if n < TOKENS:
            return none
        h = mix(self.tokens ^ mix(np.array([k + 1], dtype=U64)))
        key = (h & ~_LOW) | np.arange(n).astype(U64)
        least, span = [key], 1
        while span * 2 <= TOKENS:
            least.append(np.minimum(least[-1][:-span], least[-1][span:]))
            span *= 2
        gap = TOKENS - span
        top = np.minimum(least[-1][: len(least[-1]) - gap], least[-1][gap:]) if gap else least[-1]
        row_of = np.repeat(np.arange(len(self.token_at) - 1), np.diff(self.token_at))
        good = np.arange(len(top)) + TOKENS <= self.token_at[row_of[: len(top)] + 1]
        place = (top[good] & _LOW).astype(np.int64)
        if not len(place):
            return none
        place = place[np.append(True, place[1:] != place[:-1])]
        row = row_of[place]
        first, end = self.token_at[row], self.token_at[row + 1]
        lo, hi, own = place.copy(), place + 1, key[place]
        for level in range(len(least) - 1, -1, -1):
            span = 1 << level
            at = lo - span
            ok = at >= first
            ok[ok] &= least[level][at[ok]] > own[ok]
            lo[ok] = at[ok]
            ok = hi + span <= end
            ok[ok] &= least[level][hi[ok]] > own[ok]
            hi[ok] += span
        lo, hi = np.maximum(lo, place - SIDE), np.minimum(hi, place + SIDE + 1)
        return row, np.full(len(row), k), place, lo, hi, mix(h[place] ^ U64(k))

    def agreed(self, marked: np.ndarray) -> np.ndarray:
        """Which marked windows hold a passage that enough hash functions' marked windows cover."""
        n = len(self.tokens)
        cover = np.zeros(n + 1, dtype=np.int64)
        for k in range(HASHES):
            own = marked & (self.k == k)
            edge = np.zeros(n + 1, dtype=np.int64)
            np.add.at(edge, self.lo[own], 1)
            np.add.at(edge, self.hi[own], -1)
            cover += np.cumsum(edge) > 0
        full = np.concatenate([[0], np.cumsum(cover[:n] >= AGREE)])
        # A covered run of a passage's length starts here, by tokens:
        run = np.concatenate([[0], np.cumsum((full[TOKENS:] - full[:-TOKENS]) == TOKENS)]) if n >= TOKENS else np.zeros(1, dtype=np.int64)
        last = np.minimum(np.maximum(self.hi - TOKENS + 1, self.lo), len(run) - 1)
        return marked & (run[last] > run[np.minimum(self.lo, len(run) - 1)])


_HEAD = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("place", "<i4"), ("left", "<i2"), ("right", "<i2")])


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which tokens of b (second axis) are which of the same row of a (third axis, filled up to a multiple of eight)."""
    out = b[:, :, None] == np.pad(a, ((0, 0), (0, -a.shape[1] % 8)))[:, None, :]
    out &= (b != 0)[:, :, None]
    return out


def _hits(same: np.ndarray) -> np.ndarray:
    """Which tokens of b are in a: as ``same.any(axis=2)``, eight at a time."""
    eights = same.view(np.uint64)
    out = eights[:, :, 0].copy()
    for k in range(1, eights.shape[2]):
        out |= eights[:, :, k]
    return out != 0


def _reach(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far from the shared token each token of b next is in the same row of a, on its left and on its right; TOKENS if it isn't there."""
    out = []
    for side in (same[:, :, SIDE::-1], same[:, :, SIDE:]):
        k = side.argmax(axis=2)
        out.append(np.where(np.take_along_axis(side, k[:, :, None], axis=2)[:, :, 0], k, TOKENS))
    return out[0], out[1]


def _own(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The reach of each window's tokens in itself, and one place of each different token."""
    step = np.arange(WIDTH)
    left = np.tile(np.where(step <= SIDE, SIDE - step, TOKENS).astype(np.int8), (len(grid), 1))
    right = np.tile(np.where(step >= SIDE, step - SIDE, TOKENS).astype(np.int8), (len(grid), 1))
    s = np.sort(grid, axis=1)
    twice = np.flatnonzero(((s[:, 1:] == s[:, :-1]) & (s[:, 1:] != 0)).any(axis=1))
    for k in range(0, len(twice), 256):
        at = twice[k : k + 256]
        left[at], right[at] = _reach(_same(grid[at], grid[at]))
    return left, right, (grid != 0) & (step == np.where(left < TOKENS, SIDE - left, SIDE + right))


def _least_distinct(grid: np.ndarray) -> np.ndarray:
    """The fewest different tokens that a string of TOKENS in each window has."""
    out = np.full(len(grid), TOKENS)
    s = np.sort(grid, axis=1)
    twice = np.flatnonzero(((s[:, 1:] == s[:, :-1]) & (s[:, 1:] != 0)).any(axis=1))
    for k in range(0, len(twice), 256):
        g = grid[twice[k : k + 256]]
        order = np.argsort(g, axis=1, kind="stable")
        s = np.take_along_axis(g, order, axis=1)
        last = np.full(g.shape, -1)
        np.put_along_axis(last, order[:, 1:], np.where(s[:, 1:] == s[:, :-1], order[:, :-1], -1), axis=1)
        for x in range(SIDE + 1):
            whole = (g[:, x : x + TOKENS] != 0).all(axis=1)
            n = (last[:, x : x + TOKENS] < x).sum(axis=1)
            out[twice[k : k + 256]] = np.minimum(out[twice[k : k + 256]], np.where(whole, n, TOKENS))
    return out


def _tally(left_end, right_end, *terms) -> np.ndarray:
    """What each string (i tokens to the left, j to the right) of each row adds up to: rows, i, j; far under 0 beyond the row's ends.

    A term is a weight, the reach of tokens on both sides and which of them
    are used: each one that the string holds counts its weight, once.  A token
    on one side alone adds to that side, whatever the other; so the sums are
    outer ones but for tokens that stand on both sides.
    """
    m, n, step = len(left_end), TOKENS + 1, np.arange(TOKENS)
    row = np.arange(m)[:, None] * n
    sides = [np.where(step[None, :] > end[:, None], -10_000, 0) for end in (left_end, right_end)]
    both = []
    for weight, left, right, use in terms:
        right = np.where(left == 0, TOKENS, right)  # the shared token is in all strings
        for side, x in zip(sides, (left, right), strict=True):
            side += weight * np.bincount((row + x)[use], minlength=m * n).reshape(m, n)[:, :TOKENS].cumsum(axis=1)
        two = use & (left < TOKENS) & (right < TOKENS)
        some = np.flatnonzero(two.any(axis=1))
        if len(some):
            both.append((weight, some, left[some], right[some], two[some]))
    out = sides[0].astype(np.int16)[:, :, None] + sides[1].astype(np.int16)[:, None, :]
    for weight, some, left, right, two in both:
        at = (np.arange(len(some))[:, None] * n + left) * n + right
        count = np.bincount(at[two], minlength=len(some) * n * n).astype(np.int16).reshape(len(some), n, n)[:, :TOKENS, :TOKENS]
        out[some] -= np.int16(weight) * count.cumsum(axis=1, dtype=np.int16).cumsum(axis=2, dtype=np.int16)
    return out


def _warp(mine: np.ndarray, other: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the other window's string goes to hold what matches in mine, by steps of mine; and the step at which each distance is reached."""
    use = use & (mine < TOKENS) & (other < TOKENS)
    far = np.zeros((len(mine), TOKENS), dtype=np.int64)
    row = np.broadcast_to(np.arange(len(mine))[:, None], mine.shape)
    np.maximum.at(far, (row[use], mine[use]), other[use])
    far = np.maximum.accumulate(far, axis=1)
    return far, (far[:, None, :] < np.arange(TOKENS + 1)[None, :, None]).sum(axis=2)


_SIZE = np.arange(TOKENS)[:, None] + np.arange(TOKENS) + 1
_SIZE = np.where(_SIZE >= TOKENS, _SIZE, 0).astype(np.uint8)  # of strings that are long enough


def _longest(a: np.ndarray, b: np.ndarray, own_a, own_b, reach) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of rows the longest string of b around the middle that is similar to one of a: whether there is one, first and last place.

    Jaccard similarities are exact for all strings of b against the string of
    a that is as long on both sides, and against the one that reaches as far
    as what matches (words put in or left out shift it).  Both strings have at
    least TOKENS tokens.
    """
    (la, ra, use_a), (lb, rb, use_b), (lo, ro) = own_a, own_b, reach
    shared = use_b & ((lo < TOKENS) | (ro < TOKENS))
    (a_left, a_right), (b_left, b_right) = (((g[:, :SIDE] != 0).sum(axis=1), (g[:, SIDE + 1 :] != 0).sum(axis=1)) for g in (a, b))

    def good(rows, lo, ro, la, ra):
        """Whether DEN times the tokens in common are NUM times those of both strings together, or more."""
        l, r, s, t = lb[rows], rb[rows], use_b[rows], shared[rows]  # noqa: E741
        common = [(l, r, t), (lo, ro, t), (np.minimum(l, lo), np.minimum(r, ro), t)]  # in b, in a, in one of them
        weights = NUM + DEN, NUM + DEN, -NUM - DEN
        return _tally(b_left[rows], b_right[rows], *((w, *c) for w, c in zip(weights, common, strict=True)), (-NUM, la, ra, use_a[rows]), (-NUM, l, r, s)) >= 0

    step = np.arange(TOKENS)
    far_l, far_r = np.minimum(step, a_left[:, None]), np.minimum(step, a_right[:, None])
    ok = good(slice(None), lo, ro, la, ra)
    ok &= far_l.astype(np.int8)[:, :, None] + far_r.astype(np.int8)[:, None, :] >= SIDE
    moved = np.flatnonzero((shared & ((lo != lb) | (ro != rb))).any(axis=1))
    if len(moved):
        (far_l, at_l), (far_r, at_r) = (_warp(x[moved], y[moved], shared[moved]) for x, y in ((lb, lo), (rb, ro)))
        by = [np.take_along_axis(t, x[moved].astype(np.int64), axis=1) for t, x in ((at_l, lo), (at_r, ro), (at_l, la), (at_r, ra))]
        ok[moved] |= good(moved, *by) & (far_l.astype(np.int8)[:, :, None] + far_r.astype(np.int8)[:, None, :] >= SIDE)
    score = ok * _SIZE
    best = score.reshape(len(a), -1).argmax(axis=1)
    return score.reshape(len(a), -1)[np.arange(len(a)), best] > 0, SIDE - best // TOKENS, SIDE + best % TOKENS


def _room(hit: np.ndarray, grid: np.ndarray, single: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each row may have a string about the middle, at least left tokens to the left and right to the right, that is similar to one of a window.

    Similar strings of n and at least TOKENS tokens with b in common have
    (NUM + DEN) b >= NUM (n + TOKENS), so their tokens, DEN for each that the
    other window has and -NUM for each other one, sum up to NUM * TOKENS.  Rows
    with a token twice (not single) always may.
    """
    worth = np.where(hit, DEN, np.where(grid != 0, -NUM, -1000)).astype(np.int32)
    a = np.cumsum(worth[:, SIDE::-1], axis=1)
    b = np.concatenate([np.zeros((len(hit), 1), dtype=np.int32), np.cumsum(worth[:, SIDE + 1 :], axis=1)], axis=1)
    b = np.maximum.accumulate(b[:, ::-1], axis=1)[:, ::-1]  # from here on to the right
    step = np.arange(TOKENS)
    best = a + np.take_along_axis(b, np.minimum(np.maximum(SIDE - step[None, :], right[:, None]), SIDE), axis=1)
    best[step[None, :] < left[:, None]] = -1000
    best[right > SIDE] = -1000
    return ~single | (best.max(axis=1) >= NUM * TOKENS)


def _run(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The string around the middle that matches throughout."""
    left = np.argmax(np.append(hit[:, SIDE::-1] != 1, np.ones((len(hit), 1), dtype=bool), axis=1), axis=1) - 1
    right = np.argmax(np.append(hit[:, SIDE:] != 1, np.ones((len(hit), 1), dtype=bool), axis=1), axis=1) - 1
    return left + right + 1 >= TOKENS, SIDE - left, SIDE + right


class _Lists:
    """An inverted index of windows sorted by signature and corpus order: an entry for each different token of a window, by window.

    ``member[start + r]`` for r < ``index`` are the earlier windows of the
    signature with that token, wherever they have it.  A string of at least
    TOKENS tokens with Jaccard similarity NUM / DEN shares at least
    ``need`` = NUM / DEN of its own different tokens, so two windows with
    similar strings have one of the ``rare`` tokens in common: all but
    ``need`` - 1 of each, rarest first.
    """

    def __init__(self, head: np.ndarray, grid: np.ndarray):
        self.need = -(-NUM * _least_distinct(grid) // DEN)
        n = np.zeros(len(head), dtype=np.int32)  # different tokens, here those that no other window has
        group = np.cumsum(np.append(False, head["hash"][1:] != head["hash"][:-1])).astype(U64) << U64(32)
        key = (group[:, None] | grid)[grid != 0]
        by = np.argsort(key, kind="stable")
        new = np.append(True, key[by][1:] != key[by][:-1])
        alone = np.zeros(len(key), dtype=bool)
        alone[by] = new & np.append(new[1:], True)
        del by, new
        w, p = (x.astype(np.int32) for x in np.nonzero(grid))
        n += np.bincount(w[alone], minlength=len(head)).astype(np.int32)
        w, p, key = w[~alone], p[~alone].astype(np.int8), key[~alone]
        del alone
        order = np.lexsort((p, key, w))
        w, p, key = w[order], p[order], key[order]
        new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (key[1:] != key[:-1]))[: len(w)])
        self.first, self.last = p[new], p[np.append(new[1:], len(p)) - 1] if len(p) else p
        self.window, key = w[new], key[new]
        by = np.argsort(key, kind="stable")
        self.member = self.window[by]
        cut = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1])[: len(by)])
        size = np.diff(np.append(cut, len(by)))
        self.start, many = np.empty(len(by), dtype=np.int32), np.empty(len(by), dtype=np.int32)
        self.start[by], many[by] = np.repeat(cut, size), np.repeat(size, size)
        self.index = np.empty(len(by), dtype=np.int32)
        self.index[by] = np.arange(len(by)) - np.repeat(cut, size)
        order = np.lexsort((key, many, self.window))
        more = np.bincount(self.window, minlength=len(head)).astype(np.int32)
        rank = np.empty(len(by), dtype=np.int32)
        rank[order] = np.arange(len(by)) - np.repeat(np.cumsum(more) - more, more)
        self.rare = rank + n[self.window] <= (n + more - self.need)[self.window]


def _compare(head: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Repeats among windows sorted by signature and corpus order: places in head, first token and the one behind the last, about the place.

    A window is compared with the earlier ones of its lists in order, one in
    each round, until its whole extent is explained or the lists are used up.
    Once a part is explained, a window that shares no token outside of it has
    no word to add and is passed over.
    """
    lists = _Lists(head, grid)
    left, right, use = _own(grid)
    single = use.sum(axis=1) == (grid != 0).sum(axis=1)
    bitmap = np.zeros((len(head), 256), dtype=bool)
    bitmap[np.arange(len(head))[:, None], grid & 255] = True  # which last bytes a window's tokens have
    found = np.zeros(len(head), dtype=bool)
    lo, hi = np.full(len(head), SIDE), np.full(len(head), SIDE)  # what is explained
    live = np.flatnonzero(lists.index > 0)
    cursor = np.zeros(len(lists.index), dtype=np.int32)
    out = []
    while True:
        w = lists.window[live]
        # Behind a find, all tokens outside what is explained count, else the rare ones.
        on = np.where(found[w], (lists.first[live] < lo[w]) | (lists.last[live] >= hi[w]), lists.rare[live])
        on &= cursor[live] < lists.index[live]
        more = np.zeros(len(head), dtype=bool)
        more[w[on]] = True
        keep = more[w] & (cursor[live] < lists.index[live]) & (on | ~found[w])
        live, on = live[keep], np.flatnonzero(on[keep])
        if not len(live):
            break
        w = lists.window[live]
        partner = lists.member[lists.start[live[on]] + cursor[live[on]]]
        cut = np.flatnonzero(np.append(True, w[on][1:] != w[on][:-1]))
        other, mine = np.minimum.reduceat(partner, cut), w[on][cut]
        cursor[live[on]] += partner == np.repeat(other, np.diff(np.append(cut, len(on))))
        ok = (head["key"][other] != head["key"][mine]) | (head["place"][other] != head["place"][mine])
        at = np.flatnonzero(ok)
        for part in np.array_split(at, -(-max(1, len(at)) // 256)):
            a_, b_ = other[part], mine[part]
            marks = bitmap[a_[:, None], grid[b_] & 255] & (grid[b_] != 0)
            some = marks.sum(axis=1) >= np.maximum(lists.need[a_], lists.need[b_])
            a_, b_ = a_[some], b_[some]
            if not len(a_):
                continue
            a, b = grid[a_], grid[b_]
            equal, x, y = _run(np.where(b == 0, -1, (a == b).astype(np.int8)).astype(np.int8))
            spans = [np.stack([b_, x - SIDE, y - SIDE + 1], axis=1)[equal]]
            full = equal & (x == SIDE - head["left"][b_]) & (y == SIDE + head["right"][b_] - 1)
            rest = np.flatnonzero(~full)
            same = _same(a[rest], b[rest])
            p, q, back = a_[rest], b_[rest], _hits(same)
            some = (use[q] & back).sum(axis=1) >= np.maximum(lists.need[p], lists.need[q])
            # Behind a find, just strings that go on beyond it count.
            further = [np.where(found[q], x, 0) for x in (SIDE - lo[q] + 1, hi[q] - SIDE)]
            some &= _room(back, b[rest], single[q], further[0], 0 * q) | _room(back, b[rest], single[q], 0 * q, further[1])
            same, rest = same[some], rest[some]
            some = _room(same.any(axis=1)[:, :WIDTH], a[rest], single[a_[rest]], 0 * rest, 0 * rest)
            same, rest = same[some], rest[some]
            if len(rest):
                p, q = a_[rest], b_[rest]
                near, x, y = _longest(a[rest], b[rest], (left[p], right[p], use[p]), (left[q], right[q], use[q]), _reach(same))
                spans.append(np.stack([q, x - SIDE, y - SIDE + 1], axis=1)[near])
            got = np.concatenate(spans)
            np.minimum.at(lo, got[:, 0], got[:, 1] + SIDE)
            np.maximum.at(hi, got[:, 0], got[:, 2] + SIDE)
            found[got[:, 0]] = True
            out.append(got)
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def _may_match(hash_: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which windows (sorted by signature; their tokens end to end) share enough tokens with others of their signature to match one.

    A match shares at least NUM / DEN of TOKENS different tokens, so a window
    with fewer that any other has can't have one; without it, others may have
    fewer, too.  Windows with a token twice, which may need fewer, all stay.
    """
    which = np.repeat(np.arange(len(size)), size)
    group = np.cumsum(np.append(False, hash_[1:] != hash_[:-1]))[: len(size)].astype(U64)
    key = group[which] << U64(32) | flat
    s = np.sort(which.astype(U64) << U64(32) | flat)
    need = np.full(len(size), -(-NUM * TOKENS // DEN))
    need[(s[1:][s[1:] == s[:-1]] >> U64(32)).astype(np.int64)] = 0
    live = np.ones(len(size), dtype=bool)
    while True:
        s = np.sort(key)
        twice = s[1:][s[1:] == s[:-1]]
        shared = twice[np.minimum(np.searchsorted(twice, key), max(len(twice) - 1, 0))] == key if len(twice) else np.zeros(len(key), dtype=bool)
        gone = live & (np.bincount(which, shared, len(size)) < need)
        if not gone.any():
            return live
        live &= ~gone
        keep = live[which]
        which, key = which[keep], key[keep]


def _content(tokens: np.ndarray, head: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each window: signature, tokens, and where in it the shared token is."""
    return mix(span_hash(value_prefix(tokens.astype(U64)), lo, hi) ^ mix(head["hash"] + head["left"].astype(U64)))


def _whole(head: np.ndarray, blocks: int):
    """Spans of windows that repeat an earlier one as a whole."""
    return _spans(head["key"], head["place"] - head["left"], head["place"] + head["right"] + WORDS - 1, blocks)


def repeated_passages(rows: DataFrame, blocks: int) -> DataFrame:
    """key and spans: packed (first word, end word) of repeats; rows bring their marks."""

    def send(batches):
        for b in batches:
            keys, docs = b.column("key").to_numpy(), b.column("id").fill_null(-(1 << 63)).to_numpy()
            marks = b.column("marks")
            heads, tokens, contents = [], [], []
            for c in text_chunks(b.column("text")):
                w = Windows(c)
                marked = np.zeros(len(w.row), dtype=bool)
                for i in range(len(c)):
                    marked[w.at[i] + np.frombuffer(marks[c.lo + i].as_buffer(), np.uint32).astype(np.int64)] = True
                at = np.flatnonzero(w.agreed(marked) & (w.k < CARRY))
                head = np.zeros(len(at), dtype=_HEAD)
                row = w.row[at]
                head["hash"], head["doc"], head["key"] = w.hash[at], docs[row + c.lo], keys[row + c.lo]
                head["place"] = w.place[at] - w.token_at[row]
                head["left"], head["right"] = w.place[at] - w.lo[at], w.hi[at] - w.place[at]
                heads.append(head)
                short = np.maximum((w.tokens & _LOW).astype(np.uint32), 1)
                tokens += [short[a:e] for a, e in zip(w.lo[at], w.hi[at], strict=True)]
                contents.append(_content(short, head, w.lo[at], w.hi[at]))
            head = np.concatenate(heads) if heads else np.zeros(0, dtype=_HEAD)
            if not len(head):
                continue
            first, repeat = _firsts(head, np.concatenate(contents), "place")
            k, spans = _whole(head[repeat], blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int32()), pa.array(k, pa.int32()), pa.array(spans, pa.binary())], names=["block", "part", "packed"])
            kept = np.flatnonzero(first)
            at, parts = [], []
            for k, own in _by_block(head["hash"][kept], blocks):
                own = kept[own]
                for x in range(0, len(own), 4096):
                    some = own[x : x + 4096]
                    parts.append(np.int64(len(some)).tobytes() + head[some].tobytes() + b"".join([tokens[j].tobytes() for j in some]))
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
                texts.append(np.frombuffer(raw, np.uint32, offset=8 + n * _HEAD.itemsize))
                edge = np.append(0, np.cumsum(heads[-1]["left"] + heads[-1]["right"])).astype(np.int64)
                contents.append(_content(texts[-1], heads[-1], edge[:-1], edge[1:]))
        if not heads:
            return
        head, flat = np.concatenate(heads), np.concatenate(texts)
        size = head["left"] + head["right"]
        begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        first, repeat = _firsts(head, np.concatenate(contents), "place")
        k, spans = _whole(head[repeat], blocks)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(spans, pa.binary())], names=["part", "packed"])
        at = np.flatnonzero(first)
        _, back, count = np.unique(head["hash"][at], return_inverse=True, return_counts=True)
        at = at[count[back] > 1]
        at = at[np.lexsort((head["place"][at], head["key"][at], head["doc"][at], head["hash"][at]))]
        at = at[_may_match(head["hash"][at], np.concatenate([flat[begin[j] : begin[j + 1]] for j in at]) if len(at) else flat[:0], size[at].astype(np.int64))]
        out, lo = [], 0
        while lo < len(at):
            hi = min(lo + 20_000, len(at))
            while hi < len(at) and head["hash"][at[hi]] == head["hash"][at[hi - 1]]:
                hi += 1
            own = at[lo:hi]
            grid = np.zeros((len(own), WIDTH), dtype=np.uint32)
            which = np.repeat(np.arange(len(own)), size[own])
            step = np.arange(len(which)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
            grid[which, SIDE - head["left"][own][which] + step] = flat[begin[own][which] + step]
            found = _compare(head[own], grid)
            h = head[own][found[:, 0]]
            out.append((h["key"], h["place"] + found[:, 1], h["place"] + found[:, 2] + WORDS - 1))
            lo = hi
        if out:
            k, spans = _spans(*(np.concatenate(x) for x in zip(*out, strict=True)), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(spans, pa.binary())], names=["part", "packed"])

    sent = rows.mapInArrow(lean(send), "block int, part int, packed binary")
    dealt = sent.withColumn("deal", F.coalesce("block", "part")).repartitionById(blocks, "deal").select("block", "part", "packed")
    return by_key(dealt.mapInArrow(lean(find), "part int, packed binary"), blocks, "spans")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the columns key, id and text, beside those of docs under other names (old_*)."""
    old = docs.select([F.col(c).alias(f"old_{c}") for c in docs.columns if c != "text"] + [docs["text"].cast("string").alias("text"), docs["doc_id"].cast("long").alias("id")])
    return old.withColumn("key", F.xxhash64("id", F.coalesce("text", F.lit(""))))


_ALL = np.array([0, 1 << 62], dtype="<i8").tobytes()  # a span over whatever there is


def later_copies(rows: DataFrame) -> DataFrame:
    """key of the documents whose whole text an earlier document has: their windows say nothing new."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))  # 128 bits
    short = rows.select("key", "id", digest.alias("digest")).where(F.length("text") >= MIN_WORDS)
    first = short.groupBy("digest").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "key")).alias("first"))
    return short.join(first, "digest").where(F.col("key") != F.col("first.key")).select("key").distinct()


def with_spans(rows: DataFrame) -> DataFrame:
    """Keyed rows and spans: packed (first word, end word) that repeat an earlier passage.

    Later copies of whole texts are repeats as they are, and only other texts
    are cut into windows.  All joins read the same columns, so that the text is
    exchanged once.
    """
    batch_rows(rows.sparkSession, 2500)  # windows that repeat in a batch are sent once
    blocks = partitions(rows.sparkSession)
    copies = written(later_copies(rows), "copies")
    fresh = rows.join(copies, "key", "left_anti")
    marks = repeated_triggers(fresh, blocks, Windows)
    spans = repeated_passages(rows.join(marks, "key"), blocks)  # marks are of fresh rows only
    return rows.join(spans.unionByName(copies.select("key", F.lit(_ALL).alias("spans"))), "key", "left")


def _cut(chunk: Chunk, spans) -> list[tuple[int, np.ndarray, bytes]]:
    """Number of words, merged spans and kept bytes of each row; a span goes with the blanks behind it."""
    starts, _, at = chunk.words()
    out = []
    for i in range(len(chunk)):
        raw, first = chunk.text(i), int(at[i])
        n = int(at[i + 1]) - first
        if spans[i] is None:
            out.append((n, np.zeros((0, 2), dtype=np.int64), raw))
            continue
        if spans[i] == _ALL:
            merged = np.array([[0, n]], dtype=np.int64)[: n >= MIN_WORDS]
        else:
            merged = union(np.frombuffer(spans[i], "<i8").reshape(-1, 2))
        kept, done = [], 0
        for a, e in merged.tolist():
            kept.append(raw[done : int(starts[first + a] - chunk.offsets[i])])
            done = int(starts[first + e] - chunk.offsets[i]) if e < n else len(raw)
        kept.append(raw[done:])
        out.append((n, merged, b"".join(kept)))
    return out


def removal(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: words removed and a digest of the kept text."""

    def run(batches):
        for b in batches:
            spans = b.column(2).to_pylist()
            for c in text_chunks(b.column(1)):
                cut = _cut(c, spans[c.lo : c.hi])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(c.lo, len(c)),
                        pa.array([n for n, _, _ in cut], pa.int64()),
                        pa.array([int((s[:, 1] - s[:, 0]).sum()) for _, s, _ in cut], pa.int64()),
                        pa.array([len(s) for _, s, _ in cut], pa.int64()),
                        pa.array([hashlib.sha256(k).hexdigest() for _, _, k in cut], pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed_words", "n_spans", "kept_sha256"],
                )

    return with_spans(_keyed(docs.select("doc_id", "text")).select("key", "id", "text")).select("id", "text", "spans").mapInArrow(lean(run), SCHEMA)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages; n_chars follows the text, all else stays."""
    names = docs.columns

    def run(batches):
        for b in batches:
            spans = b.column("spans").to_pylist()
            text = b.column("text")
            new = []
            for c in text_chunks(text):
                new += [k.decode() if spans[c.lo + i] is not None else None for i, (_, _, k) in enumerate(_cut(c, spans[c.lo : c.hi]))]
            changed = pa.array([s is not None for s in spans])
            kept = pa.compute.if_else(changed, pa.array(new, pa.string()), text)
            out = {n: kept if n == "text" else b.column(f"old_{n}") for n in names}
            if "n_chars" in out:
                out["n_chars"] = pa.compute.if_else(changed, pa.compute.utf8_length(kept).cast(out["n_chars"].type), out["n_chars"])
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return with_spans(_keyed(docs)).mapInArrow(lean(run), docs.schema)
