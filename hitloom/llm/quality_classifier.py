"""A quality classifier: additive lookup tables with pairwise interactions (operator 5).

A generalised additive model: the log odds of a text are an intercept plus one
table entry for each feature's bin, plus one for each chosen pair of features.
The tables are learned by cyclic gradient boosting: round after round, one
shallow tree over the bins of one feature at a time takes a small step down
the log loss; then the pairs that explain most of what is left get tables of
their own in the same way.  Scoring looks up bins and adds; it is vectorised
and needs no shuffle.

The features are computed from the text alone, over all of it.  The model is
fitted on the driver to at most ``max_train`` labelled rows, those with the
smallest hashes of their ids among the rows whose crc32 of the id, modulo 5,
isn't 0; this bound is the only sample here.

Defined cases: a null text is empty, and an empty text gets a score as well; a
null id counts as held out; repeated labels of an id count as 1 if one of them
is 1, and of repeated rows of an id the one with the least features is learned
from; a text of any length is judged as a whole; equal hashes in the sample go
by id; without labels of both kinds all scores are the share of label 1 (0.5
without any); an empty table gives no rows; other columns are ignored or, in
``keep_good``, passed on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_rows, distinct_per_row, lean, text_chunks, word_hashes
from .quality_rules import _sums, base_features

THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
FEATURES = ["words", "word_length", "symbols", "pipes", "bangs", "capitals", "digits", "stops", "lines", "dup_lines", "repeats", "distinct", "runs", "commonest", "wide", "long_words", "lone_marks"]


def _flags(*chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for c in chars:
        out[list(c)] = True
    return out


_CAPITAL, _SMALL = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_DIGIT, _STOP = _flags(b"0123456789"), _flags(b".,;:")


def text_features(chunk) -> np.ndarray:
    """One row of features for each text of the chunk."""
    data, at = chunk.data, chunk.offsets
    base = base_features(chunk)
    starts, ends, word_at = chunk.words()
    n = base["n_words"].astype(float)
    some, size = np.maximum(n, 1), np.maximum(np.diff(at), 1).astype(float)
    count = lambda table: _sums(table[data], at)
    capitals, small = count(_CAPITAL), count(_SMALL)
    hashes, _ = word_hashes(chunk, lower=True)
    values, own = distinct_per_row(hashes, word_at)
    row = np.repeat(np.arange(len(chunk)), np.diff(word_at))
    order = np.lexsort((hashes, row))
    cuts = np.flatnonzero(np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1]))) if len(row) else np.zeros(0, dtype=int)
    commonest = np.zeros(len(chunk))
    if len(cuts):
        np.maximum.at(commonest, row[order][cuts], np.diff(np.append(cuts, len(row))))
    same = np.zeros(len(row), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    length = ends - starts
    columns = [
        np.log1p(n),
        base["word_chars"] / some,
        base["n_symbols"] / size,
        count(_flags(b"|")) / some,
        count(_flags(b"!")) / some,
        capitals / np.maximum(capitals + small, 1),
        count(_DIGIT) / size,
        count(_STOP) / some,
        count(_flags(b"\n")) / some,
        base["n_dup_lines"] / np.maximum(count(_flags(b"\n")) + 1, 1),
        base["n_repeat_words"] / some,
        np.diff(own) / some,
        _sums(same, word_at) / some,
        commonest / some,
        count(np.arange(256) >= 128) / size,
        _sums(length > 12, word_at) / some,
        _sums(length == 1, word_at) / some,
    ]
    return np.stack(columns, axis=1)


def batch_features(column: pa.Array) -> np.ndarray:
    parts = [text_features(c) for c in text_chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    """Intercept, cut points for each feature, and the lookup tables."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            z += t[np.searchsorted(self.cuts[k], x[:, k], "right")]
        for i, j, t in self.pairs:
            z += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values of a shallow tree over ordered bins: gradient and hessian sums, best splits first."""
    out = np.zeros(len(g))
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]

    def best(lo, hi):
        at = np.arange(lo + 1, hi)
        if not len(at):
            return 0.0, 0
        gl, hl, gr, hr = cg[at] - cg[lo], ch[at] - ch[lo], cg[hi] - cg[at], ch[hi] - ch[at]
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1) - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + 1), 0)
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    while len(parts) < leaves:
        found = [(*best(*p), p) for p in parts]
        gain, cut, (lo, hi) = max(found)
        if gain <= 0:
            break
        parts.remove((lo, hi))
        parts += [(lo, cut), (cut, hi)]
    for lo, hi in parts:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """A tree that cuts a grid once along each axis, in the better order; its gain."""
    best, value = 0.0, np.zeros_like(g)
    G, H = np.zeros(np.add(g.shape, 1)), np.zeros(np.add(g.shape, 1))
    G[1:, 1:], H[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            cells = []
            for (a, b), (c, d) in (((0, i), (0, j)), ((0, i), (j, g.shape[1])), ((i, g.shape[0]), (0, j)), ((i, g.shape[0]), (j, g.shape[1]))):
                cells.append((a, b, c, d, G[b, d] - G[a, d] - G[b, c] + G[a, c], H[b, d] - H[a, d] - H[b, c] + H[a, c]))
            gain = sum(x[4] ** 2 / (x[5] + 1) for x in cells if x[5] >= least)
            if gain > best:
                best, value = gain, np.zeros_like(g)
                for a, b, c, d, s, t in cells:
                    if t >= least:
                        value[a:b, c:d] = s / (t + 1)
    return value, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 20, leaves: int = 3) -> AdditiveModel:
    """Learn the tables from features x and labels y (0 or 1)."""
    prior = float(y.mean()) if len(y) else 0.5
    if not len(y) or prior in (0.0, 1.0):
        clipped = min(max(prior, 1e-6), 1 - 1e-6)
        return AdditiveModel(float(np.log(clipped / (1 - clipped))))
    m = AdditiveModel(float(np.log(prior / (1 - prior))))
    m.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    m.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, pair_bins + 1)[1:-1])) for c in x.T]
    binned = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(m.cuts)]
    rough = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(m.coarse)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    z, least = np.full(len(y), m.intercept), 2.0

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, b in enumerate(binned):
            g, h = slopes()
            step = rate * _tree(np.bincount(b, g, len(m.tables[k])), np.bincount(b, h, len(m.tables[k])), leaves, least)
            m.tables[k] += step
            z += step[b]

    def grid(i, j):
        g, h = slopes()
        shape = (len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)
        cell = rough[i] * shape[1] + rough[j]
        size = shape[0] * shape[1]
        return cell, np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape)

    ranked = sorted(((_pair_tree(*grid(i, j)[1:], least)[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    chosen = [(i, j, np.zeros((len(m.coarse[i]) + 1, len(m.coarse[j]) + 1))) for gain, i, j in ranked[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, t in chosen:
            cell, g, h = grid(i, j)
            step = rate * _pair_tree(g, h, least)[0]
            t += step
            z += step.ravel()[cell]
    m.pairs = chosen
    return m


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> AdditiveModel:
    """Fit to a bounded sample of the labelled rows that aren't held out."""
    batch_rows(docs.sparkSession, 2500)
    known = labels.select(F.col("doc_id").cast("long").alias("id_"), F.col("quality").cast("int").alias("y_")).where("id_ is not null and y_ is not null")
    known = known.where(F.crc32(F.col("id_").cast("string").cast("binary")) % 5 != 0).groupBy("id_").agg(F.max("y_").alias("y_"))
    sample = known.orderBy(F.xxhash64("id_"), "id_").limit(max_train)
    text = docs.select(F.col("doc_id").cast("long").alias("id_"), F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(sample), "id_").select("text", "y_", "id_")  # at most max_train ids are sent

    def run(batches):
        for b in batches:
            x = batch_features(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(list(x), pa.list_(pa.float64())), b.column(1)], names=["id_", "x", "y"])

    each = rows.mapInArrow(lean(run), "id_ long, x array<double>, y int").groupBy("id_").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    found = each.select("x", "y").toArrow()  # a row for each id: at most max_train
    x = np.array(found.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """One row for each document, as the module says."""

    def run(batches):
        for b in batches:
            p = model.score(batch_features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held_out")).mapInArrow(lean(run), SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted 1, with all their columns."""
    model = train(docs, labels)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(batch_features(b.column("text").cast(pa.string()))) >= THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)
