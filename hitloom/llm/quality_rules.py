"""Quality rules with n-gram perplexity bands (operator 4).

A modified Kneser-Ney model of order four over UTF-8 bytes is counted by Spark
for each language, over every document: tasks count n-grams exactly, the JVM
sums them by (language, n-gram) and smooths them by aggregates and joins, level
by level.  What leaves Spark are, for each language, sorted arrays of n-gram
hashes with their own discounted share, and of context hashes with the weight
of the level below.  A hash has ``BITS`` bits, so a language's arrays have at
most ``3 * 2**BITS`` entries of eight bytes however large the corpus is;
n-grams that fall on one hash add their shares.  Every language has a model, a
broadcast and a band of its own, however many there are, and a task loads just
those of the languages that it meets, ``TABLES`` at a time.

Each language's model is mixed half and half with that of all languages, so
that a passage in another language doesn't make a document junk.  A document
whose perplexity is outside the band of its language is rejected, beside those
that fail the base rules.  The band is fitted to all documents that pass the
base rules, never to labels: from ``spread`` interquartile ranges under the
first quartile of log perplexity (text that says too little: repetition, runs of
symbols) to as many above the third (text that nothing else resembles).  The
default of 3 is the usual outer fence of a box plot.

Defined cases: a null text is empty (no words, so it fails); a document too
short for an n-gram has perplexity null and only the base rules decide; a null
language is a language of its own; very long texts are counted and scored as
wholes, a chunk of rows at a time; repeated rows are judged each, alike; texts
of equal perplexity are judged alike, and one on a band's edge stays; further
columns are ignored or, in ``keep_good``, passed on, whatever their names; an
empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import IS_SPACE, U64, batch_rows, distinct_per_row, gram_hashes, lean, mix, prefix_hash, text_chunks, text_hash, written

ORDER = 4
BITS = 24
TABLES = 6  # languages whose tables a task holds at once
HELD = 1 << 21  # n-grams that a task gathers before it passes them on
SPREAD = 3.0
EVERY = -1  # the slot of all languages together
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS = 50
MAX_REPEATED = 50


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def grams(chunk) -> tuple[np.ndarray, np.ndarray]:
    """Codes (four bytes) of the n-grams that end at each byte from the fourth of the chunk on, and whether they lie in one row."""
    s = chunk.data.astype(np.uint32)
    codes = s[:-3] << 24 | s[1:-2] << 16 | s[2:-1] << 8 | s[3:]
    inside = np.ones(len(codes) + ORDER - 1, dtype=bool)
    at = chunk.offsets[:-1]
    for k in range(ORDER - 1):
        inside[(at + k)[at + k < len(inside)]] = False
    return codes, inside[ORDER - 1 :]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_features(chunk) -> dict[str, np.ndarray]:
    """The base counts of each row of a chunk."""
    data, offsets, rows = chunk.data, chunk.offsets, len(chunk)
    starts, ends, at = chunk.words()
    solid = ~IS_SPACE[data]
    prefix = prefix_hash(data)
    out = {"n_words": np.diff(at), "word_chars": _sums(solid & ((data & 0xC0) != 0x80), offsets), "n_symbols": _sums(_SYMBOL[data], offsets)}

    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    line_row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((line_start, line_row))
    line_start, line_row = line_start[order], line_row[order]
    line_end = np.append(line_start[1:] - 1, len(data))
    last = np.append(line_row[1:] != line_row[:-1], True)
    line_end[last] = offsets[line_row[last] + 1]
    total = np.concatenate([[0], np.cumsum(solid)])
    full = total[line_end] > total[line_start]
    h, row = text_hash(data, line_start[full], line_end[full], prefix=prefix), line_row[full]
    line_at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    out["n_dup_lines"] = np.diff(line_at) - np.diff(distinct_per_row(h, line_at)[1])

    words = text_hash(data, starts, ends, prefix=prefix)
    three, three_at = gram_hashes(words, at, 3)
    row = np.repeat(np.arange(rows), np.diff(three_at))
    order = np.lexsort((three, row))
    t, r = three[order], row[order]
    same = np.zeros(len(t) + 1, dtype=bool)
    same[1:-1] = (t[1:] == t[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(t), dtype=bool)
    twice[order] = same[:-1] | same[1:]
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    where = (np.arange(len(three)) - three_at[row] + at[row])[twice]
    np.add.at(mark, where, 1)
    np.add.at(mark, np.minimum(where + 3, len(words)), -1)
    covered = np.cumsum(mark)[:-1] > 0
    out["n_repeat_words"] = _sums(covered, at)
    return out


def count_grams(docs: DataFrame, slot_of: dict) -> DataFrame:
    """Counts by (slot, code) over all documents: slot int, code long, n long."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def merged(flush: bool):
            nonlocal size
            size = 0
            for s, parts in list(held.items()):
                code, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)
                held[s] = [(code, n)]
                size += len(code)
            if flush or size > HELD // 2:
                for s, ((code, n),) in held.items():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), s), pa.int32()), pa.array(code.astype(np.int64)), pa.array(n)], names=["slot", "code", "n"])
                held.clear()
                size = 0

        for b in batches:
            langs = b.column(1).to_pylist()
            for c in text_chunks(b.column(0)):
                if len(c.data) < ORDER:
                    continue
                codes, inside = grams(c)
                slots = np.array([slot_of[x] for x in langs[c.lo : c.hi]], dtype=np.int64)
                by_byte = np.repeat(slots, np.diff(c.offsets))[ORDER - 1 :]
                for s in np.unique(slots):
                    found = np.unique(codes[inside & (by_byte == s)], return_counts=True)
                    held.setdefault(int(s), []).append(found)
                    size += len(found[0])
                if size > HELD:
                    yield from merged(False)
        yield from merged(True)

    found = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(lean(run), "slot int, code long, n long")
    return found.groupBy("slot", "code").agg(F.sum("n").alias("n"))


def hashed(code: np.ndarray, length: int) -> np.ndarray:
    """The place of n-grams in the arrays of their order: the code itself up to three bytes, else a hash of BITS bits."""
    return code.astype(np.int64) if 8 * length <= BITS else (mix(code.astype(U64)) >> U64(64 - BITS)).astype(np.int64)


def levels(counts: DataFrame) -> DataFrame:
    """Interpolated modified Kneser-Ney from counts of the highest order: slot, order, own (else a context), code, share.

    The share of an n-gram is its discounted count over that of its context;
    that of a context is the weight of the level below.  Below the highest
    order the count of an n-gram is how many different bytes stand before it.
    """
    out, rows = [], counts.select("slot", "code", F.col("n").cast("double").alias("n"))
    for order in range(ORDER, 0, -1):
        few = rows.groupBy("slot").agg(*(F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        fitted = F.least("n1", "n2", "n3") > 0
        discounts = [F.when(fitted, F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(F.lit(flat)).alias(f"d{k}") for k, flat in ((1, 0.5), (2, 0.75), (3, 0.9))]
        few = few.select("slot", *discounts)  # a row for each language
        at = rows.join(F.broadcast(few), "slot").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        at = at.withColumn("context", F.shiftright("code", 8))
        total = at.groupBy("slot", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("gone"))
        out.append(at.join(total, ["slot", "context"]).select("slot", F.lit(order).alias("order"), F.lit(True).alias("own"), "code", ((F.col("n") - F.col("d")) / F.col("total")).alias("share")))
        out.append(total.select("slot", F.lit(order).alias("order"), F.lit(False).alias("own"), F.col("context").alias("code"), (F.col("gone") / F.col("total")).alias("share")))
        if order > 1:  # each level is read several times
            low = F.col("code").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
            rows = written(rows.groupBy("slot", low.alias("code")).agg(F.count("*").cast("double").alias("n")), "grams")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


class Tables:
    """One model: for each order the sorted hashes of n-grams and of contexts, with their shares."""

    def __init__(self, arrays: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]):
        self.arrays = arrays

    def share(self, order: int, own: bool, code: np.ndarray) -> np.ndarray:
        """Of n-grams (0 if unseen) or of their contexts (1 if unseen)."""
        at, share = self.arrays.get((order, own), ((), ()))
        if not len(at):
            return np.full(len(code), 0.0 if own else 1.0, dtype=np.float32)
        h = hashed(code, order if own else order - 1).astype(np.int32)
        k = np.minimum(np.searchsorted(at, h), len(at) - 1)
        return np.where(at[k] == h, share[k], np.float32(0.0 if own else 1.0))

    def probability(self, code: np.ndarray) -> np.ndarray:
        p = np.full(len(code), 1 / 256, dtype=np.float32)
        for order in range(1, ORDER + 1):
            low = code & np.uint32((1 << 8 * order) - 1)
            p = self.share(order, True, low) + self.share(order, False, low >> np.uint32(8)) * p
        return p


def _tables(order: np.ndarray, own: np.ndarray, at: np.ndarray, share: np.ndarray) -> Tables:
    arrays = {}
    for k in range(1, ORDER + 1):
        for o in (True, False):
            use = np.flatnonzero((order == k) & (own == o))
            where, back = np.unique(at[use], return_inverse=True)
            total = np.bincount(back, share[use]) / (1 if o else np.maximum(np.bincount(back), 1))
            arrays[k, o] = (where.astype(np.int32), np.minimum(total, 1).astype(np.float32))
    return Tables(arrays)


class PerplexityModel:
    """A broadcast of tables for each language's slot, and one for all languages."""

    def __init__(self, slot_of: dict, shared: dict):
        self.slot_of, self.shared = slot_of, shared
        self._held: dict[int, Tables] = {}

    def __getstate__(self):
        return {"slot_of": self.slot_of, "shared": self.shared, "_held": {}}

    def tables(self, slot: int) -> Tables:
        if slot not in self._held:
            while len(self._held) >= TABLES:
                del self._held[next(k for k in self._held if k != EVERY)]
            self._held[slot] = self.shared[slot].value if slot in self.shared else Tables({})
        return self._held[slot]

    def log_perplexity(self, chunk, langs: list) -> np.ndarray:
        """Of each row; NaN without an n-gram."""
        rows = len(chunk)
        if len(chunk.data) < ORDER:
            return np.full(rows, np.nan)
        codes, inside = grams(chunk)
        slots = np.array([self.slot_of[x] for x in langs], dtype=np.int64)
        by_byte = np.repeat(slots, np.diff(chunk.offsets))[ORDER - 1 :]
        every = self.tables(EVERY)
        logp = np.zeros(len(chunk.data))
        for s in np.unique(slots):
            at = np.flatnonzero(inside & (by_byte == s))
            code, back = np.unique(codes[at], return_inverse=True)
            logp[at + ORDER - 1] = np.log((self.tables(int(s)).probability(code).astype(float) + every.probability(code)) / 2)[back]
        n = _sums(np.concatenate([np.zeros(ORDER - 1, dtype=bool), inside]), chunk.offsets)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, -_sums(logp, chunk.offsets) / np.maximum(n, 1), np.nan)


def fit_model(docs: DataFrame) -> PerplexityModel:
    """Count all documents by language; a slot is a language's number."""
    spark = docs.sparkSession
    batch_rows(spark, 2500)
    languages = docs.select(F.col("lang").cast("string").alias("lang")).distinct().orderBy(F.asc_nulls_first("lang")).collect()
    slot_of = {r[0]: k for k, r in enumerate(languages)}
    counts = written(count_grams(docs, slot_of), "grams")
    counts = written(counts.unionByName(counts.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(EVERY).alias("slot"), "code", "n")), "grams")

    def places(batches):
        for b in batches:
            order, own, code = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            at = np.zeros(len(code), dtype=np.int64)
            for k in range(ORDER + 1):
                use = np.where(own, order, order - 1) == k
                at[use] = hashed(code[use].astype(np.uint32), k)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1, 2)), pa.array(at), b.column(4)], names=["slot", "order", "own", "at", "share"])

    # At most 2**BITS rows for each slot, order and kind.
    found = levels(counts).mapInArrow(places, "slot int, order int, own boolean, at long, share double").groupBy("slot", "order", "own", "at")
    found = found.agg(F.when(F.col("own"), F.sum("share")).otherwise(F.avg("share")).cast("float").alias("share")).toArrow()
    slot, order, own, at, share = (found.column(k).to_numpy() for k in ("slot", "order", "own", "at", "share"))
    by = np.argsort(slot, kind="stable")
    slot, order, own, at, share = slot[by], order[by], own[by], at[by], share[by]
    shared = {}
    for s in np.unique(slot):
        cut = slice(*np.searchsorted(slot, [s, s + 1]))
        shared[int(s)] = spark.sparkContext.broadcast(_tables(order[cut], own[cut], at[cut], share[cut]))
    return PerplexityModel(slot_of, shared)


def _judged(batch: pa.RecordBatch, text: int, lang: int, model: PerplexityModel):
    """Features, log perplexity and slot of each row of a batch."""
    langs = batch.column(lang).to_pylist()
    parts = []
    for c in text_chunks(batch.column(text)):
        parts.append(base_features(c) | {"log_perplexity": model.log_perplexity(c, langs[c.lo : c.hi])})
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {k: np.zeros(0) for k in [*FEATURES, "log_perplexity"]}
    out["slot"] = np.array([model.slot_of[x] for x in langs], dtype=np.int64)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
    return out


COUNTS = {**{k: "long" for k in FEATURES}, "base_failed": "boolean", "slot": "int", "log_perplexity": "double"}


def judge(rows: DataFrame, model: PerplexityModel) -> DataFrame:
    """Rows (the last two columns: text and language) with their features and log perplexity."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = rows.columns

    def run(batches):
        m = shared.value
        for b in batches:
            j = _judged(b, len(names) - 2, len(names) - 1, m)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], *(pa.array(j[k], pa.int64()) for k in FEATURES), pa.array(j["base_failed"], pa.bool_()), pa.array(j["slot"], pa.int32()), pa.array(j["log_perplexity"], pa.float64(), from_pandas=True)],
                names=[*names[:-2], *COUNTS],
            )

    schema = StructType(rows.schema.fields[:-2] + StructType.fromDDL(", ".join(f"{k} {v}" for k, v in COUNTS.items())).fields)
    return rows.mapInArrow(lean(run), schema)


def fit_bands(judged: DataFrame, spread: float) -> DataFrame:
    """Lower and upper log perplexity for each language: slot, low, high."""
    quart = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000).alias("q")
    found = judged.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull()).groupBy("slot").agg(quart)
    width = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.02)) * spread
    return found.select("slot", (F.col("q")[0] - width).alias("low"), (F.col("q")[1] + width).alias("high"))


def _verdict(rows: DataFrame, spread: float) -> DataFrame:
    """Judged rows, written once, with the column kept."""
    judged = written(rows, "judged")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.join(F.broadcast(fit_bands(judged, spread)), "slot", "left").withColumn("kept", ~F.col("base_failed") & inside)  # a band for each language


def quality_rules(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """One row for each document: base counts, perplexity, base_failed, kept."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return _verdict(judge(rows, fit_model(docs)), spread).select("doc_id", *FEATURES, "base_failed", "kept", F.exp("log_perplexity").alias("perplexity"))


def keep_good(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """The documents that the rules keep, with all their columns; each text is judged once and goes with its verdict."""
    own = [f"own_{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*own).select(*own, docs_column(docs, own, "text"), docs_column(docs, own, "lang"))
    kept = _verdict(judge(rows, fit_model(docs)), spread).where("kept")
    return kept.select(*(F.col(o).alias(f.name) for o, f in zip(own, docs.schema.fields, strict=True)))


def docs_column(docs: DataFrame, own: list[str], name: str):
    return F.col(own[docs.columns.index(name)]).cast("string").alias(f"judged_{name}")
