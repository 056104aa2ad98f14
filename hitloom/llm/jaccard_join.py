"""N-gram Jaccard self-join as a blocked sparse matrix product (operator 9).

Rows of the incidence matrix are the distinct shingle sets (documents with
equal sets are one row), columns are five-word shingles.  The product of the
matrix with its transpose counts overlaps; a pair can only reach the wanted
similarity if it meets in the rarest quarter of both rows, so just these
entries are multiplied, block of columns by block of columns:

1. Every document gets its set's size and class.  Shingles that many
   documents hold are noticed here; they come last in the order of columns.
   (The order decides how much work there is, never the result.)
2. The first ``n - ceil(0.75 n) + 1`` entries of each class are sent, packed,
   to the block of their column.  A block sums the overlaps of the pairs in
   its short columns.  In long columns it pairs each class with the smallest
   one and with the next only, and hands the column on to step 5.
3. Overlaps of a pair are added up over the blocks.  What the two rows may
   still share behind these entries follows from their sizes; pairs that can't
   reach the bound are discarded, and so are those whose parity bits (about
   one for each shingle, kept for each class) differ in too many places.
4. The sets of the remaining pairs are brought together, at most
   ``MEMBERS`` with one, and counted exactly.
5. Long columns whose classes aren't all in one component by now are
   multiplied in blocks of rows: rows that no chain of columns connects never
   meet, large connected parts are cut by size, and blocks of sizes too far
   apart don't meet either.  A block gets all entries of its rows' columns,
   counts the overlaps with the classes of other components, and keeps the
   pairs that may reach the bound; these are treated as in 3 and 4.  A first
   round takes the best pairs of each class and larger component only, in the
   widest columns, which joins most of large groups; a second one takes all.  Pairs inside a component can't
   change it.

Only what is needed for classes and components is computed: each link between
components is found, copies aren't expanded into pairs.

Defined cases: a null text has no words; documents without words have no
shingle and only themselves as component; fewer than five words are one
shingle; texts of any length count as wholes; pairs at exactly the wanted
similarity link; repeated rows are copies of each other; a null id's component is that of
its copies that have one, or null, and no link is followed through it; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import U64, Chunk, batch_rows, distinct_per_row, gram_hashes, lean, mix, partitions, sieved, text_chunks, word_hashes, written
from .components import components

WORDS = 5
SHORT = 16
BLOCKS = 256
MEMBERS = 256
SEEN, COMMON, MAX_COMMON = 3, 12, 131_072  # in a batch, in all, and how many are told apart
BATCH = 2500
ROW_BLOCK = 800_000
WIDE = 64
BEST = 6
PAIR = "a long, b long, n long, na int, nb int"


def shingle_sets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and their offsets."""
    words, at = word_hashes(chunk, lower=True)
    return distinct_per_row(*gram_hashes(words, at, WORDS))


def set_classes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(mix(values ^ U64(0xA0761D6478BD642F)), out=total[1:])
        return mix((total[at[1:]] - total[at[:-1]]) ^ mix(np.diff(at).astype(U64)))


def parity_bits(values: np.ndarray) -> bytes:
    """For each of about as many bits as there are values, whether an odd number of values fall on it.

    The bits in which two sets' words differ are at most as many as the
    values in which the sets do: an exact bound on what they share.
    """
    bits = 1 << max(8, int(len(values) - 1).bit_length())
    return np.packbits(np.bincount((values & U64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def may_reach(a: bytes, b: bytes, na: int, nb: int, num: int, den: int) -> bool:
    """Whether two sets' parity bits leave room for the similarity num / den."""
    x, y = sorted((a, b), key=len)
    size, y_bits = len(x) * 8, int.from_bytes(y, "little")
    length = len(y) * 8
    while length > size:
        length //= 2
        y_bits = (y_bits >> length) ^ (y_bits & ((1 << length) - 1))
    return (int.from_bytes(x, "little") ^ y_bits).bit_count() <= na + nb - 2 * -(-num * (na + nb) // (num + den))


CLASSES = {"doc_id": "long", "n": "int", "cls": "long", "kind": "int", "sketch": "binary"}


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls, sketch of each document; kind 1: a common shingle (cls) and in how many classes of a batch it is (n)."""

    def run(batches):
        for b in batches:
            seen, values = set(), []
            for c in text_chunks(b.column(1)):
                v, at = shingle_sets(c)
                cls, n = set_classes(v, at), np.diff(at)
                new = np.zeros(len(c), dtype=bool)
                for i, k in enumerate(cls.tolist()):
                    new[i] = k not in seen
                    seen.add(k)
                sketches = [parity_bits(v[at[i] : at[i + 1]]) if new[i] else None for i in range(len(c))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.lo, len(c)), pa.array(n, pa.int32()), pa.array(cls.view(np.int64)), pa.array(np.zeros(len(c)), pa.int32()), pa.array(sketches, pa.binary())], names=[*CLASSES])
                values.append(v[np.repeat(new, n)])
            if values:
                u, n = np.unique(np.concatenate(values), return_counts=True)
                u, n = u[n >= SEEN], n[n >= SEEN]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.array(n, pa.int32()), pa.array(u.view(np.int64)), pa.array(np.ones(len(u)), pa.int32()), pa.nulls(len(u), pa.binary())], names=[*CLASSES])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), ", ".join(f"{k} {v}" for k, v in CLASSES.items()))


def prefix_blocks(docs: DataFrame, common: np.ndarray, blocks: int, num: int, den: int) -> DataFrame:
    """Packed prefix entries (shingle, class, size) by block of columns.

    Of a shingle's hash 32 bits are sent beside the block: shingles that fall
    together can only add to a pair's overlap, which is verified later.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        known = shared.value
        by_value = np.argsort(known)
        ascending = known[by_value]
        for b in batches:
            seen, parts = set(), []
            for c in text_chunks(b.column(0)):
                v, at = shingle_sets(c)
                n, cls = np.diff(at), set_classes(v, at)
                new = n > 0
                for i, k in enumerate(cls.tolist()):
                    new[i] &= k not in seen
                    seen.add(k)
                row = np.repeat(np.arange(len(c)), n)
                use = new[row]
                v, row = v[use], row[use]
                if not len(v):
                    continue
                key = v >> U64(1)
                if len(known):
                    k = np.minimum(np.searchsorted(ascending, v), len(known) - 1)
                    hit = ascending[k] == v
                    key[hit] = U64(1 << 63) | by_value[k[hit]].astype(U64)
                order = np.lexsort((key, row))
                v, row = v[order], row[order]
                place = np.arange(len(row)) - np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(c)))])[row]
                take = place < n[row] - -(-num * n[row] // den) + 1
                parts.append((v[take], cls[row[take]], n[row[take]].astype(np.uint32)))
            if not parts:
                continue
            v, cls, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            block = ((v >> U64(32)) % U64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(blocks + 1))
            used = np.flatnonzero(np.diff(cuts))
            low = (v & U64(0xFFFFFFFF)).astype(np.uint32)
            packed = [low[o].tobytes() + cls[o].tobytes() + n[o].tobytes() for o in (order[cuts[k] : cuts[k + 1]] for k in used)]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["block", "entries"])

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "block int, entries binary")


def _fits(na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * np.minimum(na, nb).astype(np.int64) >= num * np.maximum(na, nb).astype(np.int64)


def multiply(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Overlap counts of pairs in the blocks' columns; rows with b null: class a (of size na) in the long column n."""

    def run(batches):
        h, cls, n = [], [], []
        for b in batches:
            for block, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = x.as_buffer()
                m = raw.size // 16
                h.append(np.frombuffer(raw, np.uint32, m).astype(U64) | U64(block << 32))
                cls.append(np.frombuffer(raw, U64, m, 4 * m))
                n.append(np.frombuffer(raw, np.uint32, m, 12 * m))
        if not h:
            return
        h, cls, n = np.concatenate(h), np.concatenate(cls), np.concatenate(n)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        order = order[np.append(same, False) | np.append(False, same)]
        order = order[np.lexsort((cls[order], h[order]))]
        h, cls, n = h[order], cls[order], n[order].astype(np.int64)
        if not len(h):
            return
        new = np.append(True, (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]))
        h, cls, n = h[new], cls[new], n[new]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(first, len(h)))
        column = np.repeat(np.arange(len(first)), size)
        long_ = size[column] > SHORT
        left, right = [], []
        for lag in range(1, min(SHORT, len(h))):
            at = np.flatnonzero((column[lag:] == column[:-lag]) & ~(long_[lag:] & (lag > 1)))
            left.append(at)
            right.append(at + lag)
        at = np.flatnonzero(long_)
        left.append(first[column[at]])
        right.append(at)
        left, right = np.concatenate(left), np.concatenate(right)
        ok = (left != right) & _fits(n[left], n[right], num, den)
        left, right = left[ok], right[ok]
        exact = ~long_[left]  # what long columns add is bounded later
        order = np.lexsort((cls[right], cls[left]))
        left, right, exact = left[order], right[order], exact[order]
        if len(left):
            start = np.flatnonzero(np.append(True, (cls[left][1:] != cls[left][:-1]) | (cls[right][1:] != cls[right][:-1])))
            count = np.add.reduceat(exact.astype(np.int64), start)
            a, b = left[start], right[start]
            yield pa.RecordBatch.from_arrays([pa.array(cls[a].view(np.int64)), pa.array(cls[b].view(np.int64)), pa.array(count), pa.array(n[a], pa.int32()), pa.array(n[b], pa.int32())], names=["a", "b", "n", "na", "nb"])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(cls[at].view(np.int64)), pa.nulls(len(at), pa.int64()), pa.array(h[at].view(np.int64)), pa.array(n[at], pa.int32()), pa.nulls(len(at), pa.int32())], names=["a", "b", "n", "na", "nb"])

    spark = blocks.sparkSession
    return blocks.repartitionById(partitions(spark), "block").mapInArrow(lean(run), PAIR)


def _need(num: int, den: int):
    """Overlap that a pair needs, less what may lie behind the shorter reaching prefix: a lower bound of its overlap in prefixes."""
    wanted = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    behind = F.greatest(*(F.ceil(F.col(c) * num / den) - 1 for c in ("na", "nb")))
    return wanted - behind


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["a", "part", "id", "members"])


def verify(pairs: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b: ids of documents) whose sets are similar enough."""
    spark = pairs.sparkSession
    hubs = pairs.groupBy("a").agg(F.count("*").alias("k")).withColumn("parts", F.ceil(F.col("k") / MEMBERS).cast("int")).drop("k")
    asked = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"))
    asked = asked.unionByName(hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("id")))
    asked = asked.groupBy("id").agg(F.collect_list(F.struct("a", "part")).alias("groups"))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def sets(batches):
        for b in batches:
            groups, ids = b.column(1).to_pylist(), b.column(2).to_pylist()
            for c in text_chunks(b.column(0)):
                v, at = shingle_sets(c)
                rows, held = [], 0
                for i in range(len(c)):
                    own = v[at[i] : at[i + 1]].tobytes()
                    for g in groups[c.lo + i]:
                        rows.append((g["a"], g["part"], ids[c.lo + i], own))
                        held += len(own)
                        if held > 1 << 22:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    def check(batches):
        hub, key = None, None
        for b in batches:
            a_of, part, ids = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            found: list[list] = [[], []]
            for i, a in enumerate(a_of):
                own = np.frombuffer(b.column(3)[i].as_buffer(), U64)
                if ids[i] == a:
                    hub, key = own.copy(), (a, part[i])
                elif key == (a, part[i]):
                    both = np.intersect1d(hub, own, assume_unique=True).size
                    if den * both >= num * (len(hub) + len(own) - both):
                        found[0].append(a)
                        found[1].append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    ready = sieved(text, asked, "id").join(asked, "id").select("text", "groups", "id").mapInArrow(lean(sets), "a long, part int, id long, members binary")
    ready = ready.repartition(partitions(spark), "a", "part").sortWithinPartitions("a", "part", F.col("id") != F.col("a"))
    return ready.mapInArrow(check, "a long, b long").distinct()


def across(place: DataFrame, num: int, den: int, best: bool) -> DataFrame:
    """Pairs of different components by their overlap in long columns, as far as they may reach the bound.

    best: for each class and larger component only the BEST pairs that overlap most.

    place: column, cls, size, root, and slack: the most entries in short
    columns that the class shares with any other.  Rows that no chain of columns
    connects never meet: connected parts of the matrix go to tasks as they are,
    as many together as fit.  A part of more than ROW_BLOCK entries is cut into
    blocks by size, and only blocks whose sizes are near enough for the wanted
    similarity meet, so that a task holds two blocks at most.
    """
    packs = max(1, -(-place.count() // ROW_BLOCK))
    linked = components(place.select(F.col("column").alias("a"), F.col("cls").alias("b")))
    place = written(place.join(linked.select(F.col("node").alias("cls"), F.col("root").alias("part")), "cls"), "parts")
    histogram = place.groupBy("part", "size").agg(F.count("*").alias("k"))
    large = histogram.groupBy("part").agg(F.sum("k").alias("entries")).where(F.col("entries") > ROW_BLOCK).select("part")
    up = Window.partitionBy("part").orderBy("size")  # a row for each size
    start = histogram.join(large, "part").withColumn("start", F.sum("k").over(up) - F.col("k"))
    spread = F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    cut = written(place.join(start, ["part", "size"]).withColumn("b", F.floor((F.col("start") + spread * F.col("k")) / ROW_BLOCK).cast("int")).drop("start", "k"), "cut")
    ranges = cut.groupBy("part", "b").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))  # a row for each block
    other = ranges.select("part", F.col("b").alias("b2"), F.col("lo").alias("lo2"))
    pairs = ranges.join(other, "part").where((F.col("b") <= F.col("b2")) & (den * F.col("hi").cast("long") >= num * F.col("lo2").cast("long")))
    pairs = written(pairs.select("part", "b", "b2", (F.row_number().over(Window.orderBy("part", "b", "b2")) + packs - 1).alias("block")), "blocks")  # a row for each pair of blocks
    sides = pairs.select("part", "b", "block", F.when(F.col("b") == F.col("b2"), 3).otherwise(1).alias("side"))
    sides = sides.unionByName(pairs.where("b < b2").select("part", F.col("b2").alias("b"), "block", F.lit(2).alias("side")))
    names = ["block", "column", "cls", "size", "root", "slack", "side"]
    whole = place.join(large, "part", "left_anti").withColumn("block", F.pmod(F.xxhash64("part"), F.lit(packs)).cast("int")).withColumn("side", F.lit(3))
    entries = whole.select(*names).unionByName(cut.join(sides, ["part", "b"]).select(*names))
    tasks = packs + pairs.count()

    def run(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not parts:
            return
        block, column, cls, size, root, slack, side = (np.concatenate(x) for x in zip(*parts, strict=True))
        for k in np.unique(block):
            at = np.flatnonzero(block == k)
            names, who = np.unique(cls[at], return_inverse=True)
            n, r, free, sides = (np.zeros(len(names), dtype=np.int64) for _ in range(4))
            n[who], r[who], free[who], sides[who] = size[at], root[at], slack[at], side[at]
            both = sides == 3  # a block with itself; else rows of side 1 meet those of side 2
            _, of, count = np.unique(r, return_inverse=True, return_counts=True)
            many = count[of]
            _, col = np.unique(column[at], return_inverse=True)
            by_col = np.argsort(col, kind="stable")
            col_at = np.searchsorted(col[by_col], np.arange(col.max() + 2))
            by_row = np.argsort(who, kind="stable")
            row_at = np.searchsorted(who[by_row], np.arange(len(names) + 1))
            members = who[by_col]
            for i in np.flatnonzero((sides == 1) | both) if not best else range(len(names)):
                cols = col[by_row[row_at[i] : row_at[i + 1]]]
                j, overlap = np.unique(np.concatenate([members[col_at[c] : col_at[c + 1]] for c in cols]), return_counts=True)
                ok = (r[j] != r[i]) & ((sides[j] != sides[i]) | (both[j] & (best | (j > i)))) & _fits(n[j], n[i], num, den)
                need = -(-num * (n[i] + n[j]) // (num + den)) - (-(-num * np.maximum(n[i], n[j]) // den) - 1)
                ok &= overlap + np.minimum(free[i], free[j]) >= need
                if best:
                    ok &= (many[j] > many[i]) | ((many[j] == many[i]) & (r[j] < r[i]))
                j, overlap = j[ok], overlap[ok]
                if best and len(j):
                    order = np.lexsort((-overlap, r[j]))
                    j, overlap = j[order], overlap[order]
                    same = np.append(False, r[j][1:] == r[j][:-1])
                    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(j))))
                    few = np.arange(len(j)) - start < BEST
                    j, overlap = j[few], overlap[few]
                if len(j):
                    me = np.full(len(j), names[i])
                    a, b = np.minimum(me, names[j]), np.maximum(me, names[j])
                    swap = a != me
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(overlap, pa.int64()), pa.array(np.where(swap, n[j], n[i]), pa.int32()), pa.array(np.where(swap, n[i], n[j]), pa.int32())], names=["a", "b", "n", "na", "nb"])

    return entries.repartitionById(tasks, "block").mapInArrow(lean(run), PAIR).dropDuplicates(["a", "b"])


def jaccard_components(docs: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """doc_id, n_shingles and component_id of each document, links from similarity num / den on."""
    batch_rows(docs.sparkSession, BATCH)
    spark = docs.sparkSession
    rows = written(classify(docs), "classes")
    own = rows.where("kind = 0").select("doc_id", "n", "cls")
    classes = written(rows.where("kind = 0 and n > 0").groupBy("cls").agg(F.min("doc_id").alias("id"), F.max("sketch").alias("sketch")), "classes")
    common = rows.where("kind = 1").groupBy("cls").agg(F.sum("n").alias("k")).where(F.col("k") >= COMMON).orderBy(F.desc("k"), "cls").limit(MAX_COMMON).select("cls").toArrow()
    common = common.column(0).to_numpy().astype(np.int64).view(U64)[::-1].copy()  # the most frequent last

    found = written(multiply(prefix_blocks(docs, common, max(BLOCKS, 4 * partitions(spark)), num, den), num, den), "overlaps")
    columns = found.where("b is null").select(F.col("n").alias("column"), F.col("a").alias("cls"), F.col("na").alias("size"))
    held = columns.groupBy("cls").agg(F.count("*").alias("long"))

    def sift(batches):
        for b in batches:
            na, nb, x, y = (b.column(k).to_pylist() for k in range(2, 6))
            yield b.select([0, 1]).filter(pa.array([may_reach(*v, num, den) for v in zip(x, y, na, nb, strict=True)], pa.bool_()))

    def named_pairs(pairs):
        """Pairs of classes as pairs of documents, without those whose parity bits differ too much."""
        for c in "ab":
            pairs = pairs.join(classes.select(F.col("cls").alias(c), F.col("id").alias(f"id_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
        near = pairs.select("id_a", "id_b", "na", "nb", "sketch_a", "sketch_b").mapInArrow(sift, "id_a long, id_b long")
        return near.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).where("a != b").distinct()

    def candidates(pairs):
        """Pairs of classes (a, b, n: overlap in short columns) that may reach the bound, as pairs of documents."""
        pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        for c in "ab":
            pairs = pairs.join(held.select(F.col("cls").alias(c), F.col("long").alias(f"long_{c}")), c, "left")
        seen = F.col("n") + F.coalesce(F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0))), F.lit(0))
        return named_pairs(pairs.where(seen >= _need(num, den)))

    links = written(verify(written(candidates(found.where("b is not null")), "pairs"), docs, num, den), "links")
    roots = components(links)
    short = found.where("b is not null").groupBy("a", "b").agg(F.sum("n").alias("short"))
    most = short.select(F.explode(F.array("a", "b")).alias("cls"), "short").groupBy("cls").agg(F.max("short").alias("slack"))
    for best in (True, False) if not columns.isEmpty() else ():
        place = columns.join(classes, "cls").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("column", "cls", "size", F.coalesce("root", "id").alias("root"))
        open_ = place.groupBy("column").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo != hi").where(F.col("k") > (WIDE if best else 0)).select("column")
        place = written(place.join(open_, "column", "left_semi").join(most, "cls", "left").select("column", "cls", "size", "root", F.coalesce("slack", F.lit(0)).alias("slack")), "open")
        more = across(place, num, den, best).join(short, ["a", "b"], "left").withColumn("n", F.col("n") + F.coalesce("short", F.lit(0)))
        late = written(verify(written(named_pairs(more.where(F.col("n") >= _need(num, den))), "pairs"), docs, num, den), "links")
        if not late.isEmpty():
            links = links.unionByName(late)
            roots = components(links)
    named = classes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("cls", F.coalesce("root", "id").alias("component_id"))
    return own.join(named, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The first document of each component, once, with all its columns; rows without an id stay."""
    own = jaccard_components(docs)
    ids = docs["doc_id"].cast("long")
    gone = own.where("doc_id != component_id").select(F.col("doc_id").alias("gone_"))
    kept = docs.join(gone, ids == gone["gone_"], "left_anti")
    twice = own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice_"))
    if twice.isEmpty():
        return kept
    once = kept.join(twice, ids == twice["twice_"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, ids == twice["twice_"], "left_anti").unionByName(once)
