"""Target-distribution importance resampling (operator 13).

Words and pairs of words are hashed (CRC-32) into a fixed number of buckets.
The corpus becomes inverted postings (bucket, document, count), shuffled by
ranges of buckets; each bucket's gain, the log ratio of its smoothed shares in
the target texts and in the corpus, is computed where the counts of the two
are brought together, and joined to the postings of its range; what each
posting contributes is summed up by document.  A document's weight is the mean
gain of its features; a seeded Gumbel draw is added and the highest scores are
drawn, which samples without replacement in proportion to exp(weight).

Postings of a chunk of documents travel as one packed row for each range of
buckets, sorted by bucket: a document is known in it by its place in the
chunk.  The packed table is written once, so that chunks are the same for all
that read them.  No bucket owns a task, however frequent: ranges of buckets
are salted by chunk, and counts are summed in each task before they are
shuffled.  Gains are ``buckets`` rows.  Documents are ranked by the number of
higher scores, of which there are at most some 150,000 different ones (a gain
is a logarithm of counts below 2**63, a draw of a 32-bit number); a window
holds one score, in order of the ids.

Defined cases: a null or empty text has no words, no features and weight 0; a
null id draws as the empty text and comes first among ties; repeated rows
(equal id and counts) are drawn each on their own, in any order among
themselves; texts of any length count as wholes; other columns are ignored,
whatever their names; an empty corpus gives no rows; empty target texts have
no features, and gains follow from the corpus alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Chunk, batch_rows, lean, partitions, scanned, struct_batch, text_chunks, written

C = F.col
BUCKETS = 10_000
#: buckets in one range
RANGE = 250
#: bytes of text in a chunk, and documents at most (their places take 16 bits)
CHUNK = 4 << 20
MAX_DOCS = 60_000
#: longer words are left to zlib
LONG_WORD = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.zeros(256, dtype=bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = _SOLID[128:] = True
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_T = _crc_table()
_SHIFTS: dict[int, np.ndarray] = {}


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values by its tables for the four bytes."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _shift(n: int) -> np.ndarray:
    """Tables of what n zero bytes do to the register."""
    if n not in _SHIFTS:
        if len(_SHIFTS) > 2048:
            _SHIFTS.clear()
        byte = np.arange(256, dtype=np.uint32)
        if n <= 1:
            eye = np.stack([byte << (8 * k) for k in range(4)])
            _SHIFTS[n] = eye if n == 0 else _T[eye & 255] ^ (eye >> 8)
        else:
            half = _shift(n // 2)
            twice = _apply(half, half)
            _SHIFTS[n] = _apply(_shift(1), twice) if n % 2 else twice
    return _SHIFTS[n]


def feature_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each word, and of 'word word' for each word that follows another one (``follows``: not the first of its text).

    The register is linear over GF(2): a pair's value is that of its first
    word, moved on by the length of the rest, plus that of the rest alone.
    """
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, n = starts[order], size[order]
    register = np.zeros(len(order), dtype=np.uint32)  # begun at zero
    least = int(np.searchsorted(-n, -LONG_WORD, "left"))
    for k in range(least):
        word = data[at[k] : at[k] + n[k]].tobytes()
        begun = _apply(_shift(int(n[k])), np.array([_ONES]))[0]
        register[k] = np.uint32(zlib.crc32(word)) ^ _ONES ^ begun
    own, where, left = register[least:], at[least:], n[least:]
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k, "left"))
        c = own[:live]
        own[:live] = _T[(c ^ data[where[:live] + k]) & 255] ^ (c >> 8)
    alone = np.empty_like(register)
    alone[order] = register
    word, rest = np.empty_like(alone), np.empty_like(alone)
    edges = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.zeros(0, dtype=np.int64)
    groups = [order[a:b] for a, b in zip(edges, np.append(edges, len(order))[1:], strict=True)]
    for g in groups:
        moved = _apply(_shift(int(size[g[0]])), np.array([_ONES, _T[32]]))
        word[g] = alone[g] ^ moved[0]
        rest[g] = alone[g] ^ moved[1]
    pair = np.zeros_like(alone)
    for g in groups:
        g = g[follows[g]]
        if len(g):
            pair[g] = _apply(_shift(int(size[g[0]]) + 1), word[g - 1]) ^ rest[g]
    return word ^ _ONES, (pair ^ _ONES)[follows]


class Features:
    """Buckets of all features of a chunk: one for each word, and one for each pair."""

    def __init__(self, chunk: Chunk, buckets: int):
        data = _LOWER[chunk.data]
        starts, ends, at = chunk.words(_SOLID)
        self.n_words = np.diff(at)
        doc = np.repeat(np.arange(len(chunk)), self.n_words)
        follows = np.ones(len(starts), dtype=bool)
        follows[at[:-1][self.n_words > 0]] = False
        word, pair = feature_crcs(data, starts, ends, follows)
        self.doc = np.concatenate([doc, doc[follows]])
        self.bucket = np.concatenate([word, pair]).astype(np.int64) % buckets
        self.n_features = np.maximum(2 * self.n_words - 1, 0)


def _chunks(column: pa.Array):
    for chunk in text_chunks(column, CHUNK):
        for lo in range(0, len(chunk), MAX_DOCS):
            hi = min(len(chunk), lo + MAX_DOCS)
            a, b = chunk.offsets[lo], chunk.offsets[hi]
            yield Chunk(chunk.lo + lo, chunk.lo + hi, chunk.data[a:b], chunk.offsets[lo : hi + 1] - a)


def _squeeze(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(a.tobytes() for a in arrays), codec="zstd", asbytes=True)


def _open(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)


POSTINGS = "chunk long, part int, n_docs long, n long, packed binary, sums array<long>"
_POSTINGS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n", pa.int64()), ("packed", pa.binary()), ("sums", pa.list_(pa.int64()))])
DOCS_PART = -1


def _pack(f: Features, buckets: int):
    """part, number of postings and packed postings: the number in each bucket, places of documents, counts.

    A count of more than 255 is several postings.
    """
    n_docs = len(f.n_words)
    key, count = np.unique(f.bucket * n_docs + f.doc, return_counts=True)
    times = -(-count // 255)
    last = np.cumsum(times) - 1
    full = np.full(int(times.sum()), 255, dtype=np.uint8)
    full[last] = count - 255 * (times - 1)
    bucket, doc = np.divmod(np.repeat(key, times), n_docs)
    parts = -(-buckets // RANGE)
    cut = np.searchsorted(bucket, np.arange(parts + 1) * RANGE)
    for part in range(parts):
        a, b = cut[part], cut[part + 1]
        if a < b:
            sizes = np.bincount(bucket[a:b] - part * RANGE, minlength=RANGE).astype(np.uint32)
            yield part, int(b - a), _squeeze(sizes, doc[a:b].astype(np.uint16), full[a:b])


def postings(docs: DataFrame, buckets: int = BUCKETS, only_sums: bool = False) -> DataFrame:
    """Packed postings by chunk and range of buckets, the chunks' documents (part -1), and each task's sums by range."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        sums = np.zeros(-(-buckets // RANGE) * RANGE, dtype=np.int64)
        for b in batches:
            ids = b.column(0)
            for chunk in _chunks(b.column(1)):
                f = Features(chunk, buckets)
                sums += np.bincount(f.bucket, minlength=len(sums))
                if only_sums:
                    continue
                own = ids.slice(chunk.lo, len(chunk))
                known = own.is_valid().to_numpy(zero_copy_only=False)
                rows = [(DOCS_PART, len(chunk), _squeeze(own.fill_null(0).to_numpy().astype(np.int64), f.n_words.astype(np.int64), known)), *_pack(f, buckets)]
                yield struct_batch(_POSTINGS, chunk=[number] * len(rows), part=[r[0] for r in rows], n_docs=[len(chunk)] * len(rows), n=[r[1] for r in rows], packed=[r[2] for r in rows], sums=[None] * len(rows))
                number += 1
        parts = range(len(sums) // RANGE)
        yield struct_batch(_POSTINGS, chunk=[None for _ in parts], part=list(parts), n_docs=[None for _ in parts], n=[None for _ in parts], packed=[None for _ in parts], sums=[sums[p * RANGE : (p + 1) * RANGE] for p in parts])

    return docs.select(C("doc_id").cast("long"), C("text").cast("string")).mapInArrow(lean(run), POSTINGS)


def _counts(table: DataFrame, name: str) -> DataFrame:
    """bucket and how many features fall into it, from the sums of the tasks."""
    cells = table.where("sums is not null").select("part", F.posexplode("sums").alias("k", "n"))
    return cells.groupBy((C("part") * RANGE + C("k")).alias("bucket")).agg(F.sum("n").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, from the two corpora's counts brought together by bucket."""
    both = _counts(corpus, "s").join(_counts(target, "t"), "bucket", "full").na.fill(0, ["s", "t"]).where(C("bucket") < buckets)
    all_s, all_t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    share = (C("t") + 1.0) * F.lit(float(all_s + buckets)) / ((C("s") + 1.0) * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(share)).alias("gain"))


def _contributions(batches):
    """chunk and what its documents get from one range of buckets."""
    for b in batches:
        out = []
        for n, packed, own, docs in zip(b.column("n").to_pylist(), b.column("packed"), b.column("gains"), b.column("n_docs").to_pylist(), strict=True):
            raw = _open(packed.as_py(), 4 * RANGE + 3 * n)
            sizes = np.frombuffer(raw, np.uint32, RANGE)
            place = np.frombuffer(raw, np.uint16, n, 4 * RANGE)
            count = np.frombuffer(raw, np.uint8, n, 4 * RANGE + 2 * n)
            gain = np.repeat(own.values.to_numpy(), sizes)  # whole numbers below 2**53
            out.append(_squeeze(np.bincount(place, weights=gain * count, minlength=docs).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "packed"])


WEIGHTS = "doc_id long, n_words long, n_features long, weight long"
_WEIGHTS = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_features", "weight")])


def _reduce(table: pa.Table) -> pa.Table:
    """One chunk: its documents, and what they got from each range of buckets."""
    total, docs = 0, None
    n = max(table.column("n").to_pylist())
    for part, packed in zip(table.column("part").to_pylist(), table.column("packed"), strict=True):
        if part == DOCS_PART:
            raw = _open(packed.as_py(), 17 * n)
            docs = [np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, bool, n, 16 * n)]
        else:
            total = total + np.frombuffer(_open(packed.as_py(), 8 * n), np.int64)
    ids, n_words, known = docs
    features = np.maximum(2 * n_words - 1, 0)
    weight = np.where(features > 0, total // np.maximum(features, 1), 0)
    return pa.Table.from_arrays([pa.array(ids, mask=~known), pa.array(n_words), pa.array(features), pa.array(weight, pa.int64())], schema=_WEIGHTS)


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of docs; target needs doc_id and text."""
    spark = docs.sparkSession
    batch_rows(spark, 10_000, 16 << 20)
    table = written(postings(scanned(docs)[0], buckets), "postings")
    found = gains(table, written(postings(target, buckets, only_sums=True), "target"), buckets)
    parts = -(-buckets // RANGE)
    salts = max(1, -(-2 * partitions(spark) // parts))
    salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    ranges = found.groupBy(F.floor(C("bucket") / RANGE).cast("int").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("own"))  # RANGE gains
    padded = F.concat("own", F.array_repeat(F.lit(0).cast("long"), F.lit(RANGE) - F.size("own"))).alias("gains")
    ranges = ranges.select("part", padded, salted)
    rows = table.where((C("part") >= 0) & C("chunk").isNotNull()).select("chunk", "part", "n_docs", "n", "packed", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"))
    dealt = rows.join(ranges.hint("shuffle_hash"), ["part", "salt"])
    given = dealt.select("chunk", "n_docs", "n", "packed", "gains").mapInArrow(lean(_contributions), "chunk long, packed binary")
    both = given.select("chunk", F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), "packed").unionByName(table.where(C("part") == DOCS_PART).select("chunk", "part", "n", "packed"))
    return both.groupBy("chunk").applyInArrow(_reduce, WEIGHTS)


def gumbel(key: str | Column, seed: int) -> Column:
    """A thousandth-scaled Gumbel draw by the sha256 of seed and id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce((C(key) if isinstance(key, str) else key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row; rank is null where the row isn't drawn.

    percent of the documents of at least min_words words are drawn (rounded down), the highest scores first.
    """
    scored = weights(docs, target, buckets).withColumn("score", (C("weight") + gumbel("doc_id", seed)).cast("long"))
    rows = written(scored.groupBy("doc_id", "n_words", "n_features", "weight", "score").agg(F.count("*").alias("copies")), "scores")
    fit = rows.where(C("n_words") >= min_words)
    steps = fit.groupBy("score").agg(F.sum("copies").alias("n"))
    steps = steps.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score"))) - C("n"))  # distinct scores, bounded by their range
    drawn = (fit.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] * percent) // 100
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, 0)
    high = fit.join(steps.where(C("above") < drawn).select("score", "above"), "score")
    high = high.select("doc_id", "n_features", "weight", "score", "copies", (C("above") + F.sum("copies").over(order) - C("copies")).alias("before"))
    low = rows.join(steps.where(C("above") < drawn).select("score", F.lit(True).alias("high")), "score", "left").where(C("high").isNull() | (C("n_words") < min_words))
    every = high.unionByName(low.select("doc_id", "n_features", "weight", "score", "copies", F.lit(None).cast("long").alias("before")))
    each = every.select("doc_id", "n_features", "weight", "score", "before", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("k"))
    place = C("before") + C("k")
    return each.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
