"""Shared helpers: vectorised text scanning, packed shuffles, shared tables.

Text is handled as UTF-8 bytes in NumPy arrays, a bounded chunk of rows at a
time, so that no operator loops over words in Python.  Words are maximal runs
of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa

U64 = np.uint64
MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64) + U64(77))
_BYTE_LOWER = _BYTE[_LOWER]
_POWERS = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INV)):
            out = np.empty(size, dtype=U64)
            out[0], done, step = 1, 1, b
            while done < size:
                m = min(done, size - done)
                with np.errstate(over="ignore"):
                    out[done : done + m] = out[:m] * U64(step)
                done += m
                step = step * step & MASK
            _POWERS[k] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` reads any span from it."""
    out = np.zeros(len(data) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), whatever stands around them."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * _powers(len(prefix))[1][start])


#: bytes up to which a span goes by the polynomial: modulo 2**64 it has known collisions from 1,024 bytes on
LONG_SPAN = 64


def text_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, prefix: np.ndarray | None = None) -> np.ndarray:
    """A hash of each span of bytes: the polynomial one for short spans, a cryptographic digest for longer ones."""
    out = span_hash(prefix_hash(data, lower) if prefix is None else prefix, starts, ends)
    for k in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        own = data[starts[k] : ends[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(own.lower() if lower else own, digest_size=8).digest(), "little")
    return out


def value_prefix(values: np.ndarray) -> np.ndarray:
    """The same over a sequence of 64-bit values."""
    out = np.zeros(len(values) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(values) * _powers(len(values) + 1)[0][:-1], out=out[1:])
    return out


class Chunk:
    """Some consecutive rows of a batch: their bytes laid end to end."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, solid_bytes: np.ndarray = ~IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and len(self) + 1 word offsets; solid_bytes flags the 256 bytes that words are made of."""
        n = len(self.data)
        if not n:
            z = np.zeros(0, dtype=np.int64)
            return z, z, np.zeros(len(self) + 1, dtype=np.int64)
        solid = solid_bytes[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        edge[0] = edge[n] = True
        cut = edge.copy()
        cut[1:n] |= ~solid[:-1]
        starts = np.flatnonzero(solid & cut[:n])
        cut = edge
        cut[1:n] |= ~solid[1:]
        ends = np.flatnonzero(solid & cut[1:]) + 1
        return starts, ends, np.searchsorted(starts, self.offsets, "left")


def text_chunks(column: pa.Array, limit: int = 1 << 20):
    """Chunks of a string column of about ``limit`` bytes (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def word_hashes(chunk: Chunk, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the word offsets of the rows."""
    starts, ends, at = chunk.words()
    return text_hash(chunk.data, starts, ends, lower), at


def gram_hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, in order, and their offsets.

    A row with fewer than n words, but at least one, has its whole sequence
    as its one shingle.
    """
    count = np.diff(at)
    have = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(have)])
    if not len(words):
        return np.zeros(0, dtype=U64), out_at
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(words) - n + 1), dtype=U64)
        for k in range(n):
            total += words[k : k + len(total)] * U64(pow(_BASE, k + 1, 1 << 64))
        total = mix(total)
        row = np.repeat(np.arange(len(count)), have)
        place = np.arange(out_at[-1]) - out_at[row] + at[row]
        short = count[row] < n
        out = np.empty(len(row), dtype=U64)
        out[~short] = total[place[~short]]
        for i in np.flatnonzero(short):
            own = words[at[row[i]] : at[row[i] + 1]]
            h = U64(len(own))
            for k, w in enumerate(own):
                h += w * U64(pow(_BASE, k + 1, 1 << 64))
            out[i] = mix(h ^ U64(0x5BD1E995))
    return out, out_at


def distinct_per_row(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending, and their offsets."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, row))
    v = values[order]
    if not len(v):
        return v, np.zeros(len(at), dtype=np.int64)
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
    counts = np.bincount(row[new], minlength=len(at) - 1)
    return v[new], np.concatenate([[0], np.cumsum(counts)])


def crc32_text(column):
    """Spark's crc32 of a column rendered as text."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(column).cast("string").cast("binary")) if isinstance(column, str) else F.crc32(column.cast("string").cast("binary"))


_OWN: list[str] = []
_WRITTEN: list[tuple] = []


def shared_dir(spark) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only on one machine (local mode, tests) a folder of our own is made and
    named in the session where it names none; on a cluster that is an error,
    as each executor would write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="hitloom-shared-")
        _OWN.append(path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df, name: str = "t"):
    """df as a table in the shared folder: lineage ends here.

    A lost executor costs no more than the stage that is running; the table
    is read again by as many tasks as the reader likes.  Lazy results may read
    it later, so it stays until ``tidy`` or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/hitloom-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.parquet(path)


def _delete(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def erase(spark, *frames) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/hitloom-" in f:
                _delete(spark, f)


@atexit.register
def tidy() -> None:
    """Delete all tables that operators of this driver have written; results that weren't taken yet can't be read any more."""
    while _WRITTEN:
        with contextlib.suppress(Exception):  # the session may have ended already
            _delete(*_WRITTEN.pop())
    while _OWN:
        shutil.rmtree(_OWN.pop(), ignore_errors=True)


BATCH_BYTES = 32 << 20


def batch_rows(spark, n: int, size: int = BATCH_BYTES) -> None:
    """From now on Arrow batches have at most n rows and about ``size`` bytes: bounds what the JVM and Python hold of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def scanned(df):
    """df as a plan that reads files row by row, and the bytes of the columns as stored.

    Such a plan gives the same rows in the same batches however often a task
    runs.  Any other (behind a shuffle, from memory) is written first.
    """

    def plain(plan) -> bool:
        name = plan.nodeName()
        if name in ("Project", "Filter") and plan.deterministic():
            return plain(plan.child())
        return name.startswith(("LogicalRelation", "Relation"))

    plan = df._jdf.queryExecution().optimizedPlan()
    if not plain(plan):
        df = written(df, "scan")
        plan = df._jdf.queryExecution().optimizedPlan()
    return df, int(str(plan.stats().sizeInBytes()))


def lean(run):
    """A batch function whose worker gives freed memory back when a task ends."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))




def struct_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from NumPy arrays or lists."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


SIEVE_BITS = 23


def sieved(rows, ids, id_name: str):
    """The rows whose id may be among ids, by a bitmap of 2**SIEVE_BITS bits.

    The bitmap's size is fixed, so it can be sent to every task however large
    the tables are; rows that it lets through by chance are for a join behind
    it to drop.  It spares that join's shuffle most of the text.
    """
    from pyspark.sql import functions as F

    place = F.xxhash64(id_name).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    words = ids.select(place.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (SIEVE_BITS - 6), dtype=np.int64)
    bitmap[words["w"].to_numpy()] = words["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = shared.value.view(U64)
        for b in batches:
            h = b.column(b.num_columns - 1).to_numpy()
            yield b.select(range(b.num_columns - 1)).filter(pa.array((bits[h >> 6] >> (h & 63).astype(U64)) & U64(1) == 1))

    return rows.withColumn("sieve_", place).mapInArrow(lean(run), rows.schema)
