"""Exact n-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its word shingles. Sets fall into size bands, so that two sets of the
wanted similarity differ in at most k elements, where k depends on the band alone. The feature domain is
divided into n1 partitions of n2 parts. With n1 = (k + 1) / (k2 + 1), some partition holds at most k2 of the
differing elements, so some n2 - k2 of its parts are the same in both sets: a signature is the hash of one
such subset of parts, and sets that link share at least one. `extra` more partitions guarantee extra + 1
shared ones, so a set may leave out up to `extra` signatures if all sets do so in one order: first those that rest
on no element (all of them, or none if there are more), then, as far as that leaves some to spare, those that
most sets have, as the signatures that rest alone on a passage which many documents quote. Of the signatures that
two sets share, the set that goes further in that order lacks all that the other lacks, and it lacks no more than
`extra`, so one remains.

Sets that share a signature are candidates (cluster.py). Verification is exact: parity sketches, whose
differing bits are never more than the sets' differing elements, rule out most pairs, and the others are
compared as sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import SKETCH, classes, folded, hot_keys, one_key_per_set, shared_keys
from .common import discard, filtered_by_keys, materialize, release, row_key, shrink_executors, small_batches, tidy, worker_cache

SHINGLE = 4
#: Least similarity of linked sets, as parts of a hundred.
PERCENT = 85
BAND_RATIO = 1.35
K2, N2 = 1, 3
#: Documents that share a signature which may be left out for being frequent.
FREQUENT = 16
#: Parts of the signatures that are dealt out one after the other, so that the shuffle files of one are gone before the next.
PASSES = 3
#: One document in so many tells which signatures are so frequent that their rows are dealt over tasks.
SAMPLE = 16
#: Least buckets for each element of the sketches that rule out pairs within the join.
WIDE = 0.75
#: Word hashes that a worker keeps, and set identities that a task remembers.
CACHE, SEEN = 100_000, 200_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = value
        return value


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a UTF-8 text, lower-cased in A-Z.

    Words are runs free of ASCII white space. Fewer than k words make one shingle, none an empty set.
    """
    words = (text or b"").lower().split()  # of bytes: both touch ASCII only
    if not words:
        return np.empty(0, np.uint64)
    get = _HASHES.__getitem__
    h = np.fromiter(map(get, words), np.uint64, len(words))
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = _mix(out * _M1 + h[i : i + n])
    return np.unique(out)


class Bands:
    """Size bands of a similarity: band t holds sizes from starts[t] up to starts[t + 1] - 1."""

    def __init__(self, percent: int = PERCENT, ratio: float = BAND_RATIO, top: int = 1 << 40):
        self.gamma = Fraction(percent, 100)
        self.starts = [1]
        while self.starts[-1] < top:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * ratio)))
        self._starts = np.array(self.starts)

    def differing(self, band: int) -> int:
        """Most elements in which two linked sets of this band, or one of it and a smaller one, differ."""
        most = 2 * (self.starts[band + 1] - 1)
        return int(most * (1 - self.gamma) / (1 + self.gamma))

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size has signatures: its own, and the next if that has partners."""
        t = int(np.searchsorted(self._starts, size, "right")) - 1
        return [t, t + 1] if Fraction(size) / self.gamma >= self.starts[t + 1] else [t]

    def shape(self, band: int) -> tuple[int, int]:
        """Partitions of a band, and how many signatures a set may leave out."""
        k = self.differing(band)
        extra = k // 6
        return -(-(k + 1) // (K2 + 1)) + extra, extra


def signatures(x: np.ndarray, bands: Bands) -> tuple[np.ndarray, int]:
    """Signatures of a set of hashes, for all its bands, and how many of them it may spare whatever band a partner shares."""
    out, spare = [], []
    for band in bands.of(len(x)):
        if bands.differing(band) == 0:
            out.append(_mix(np.array([x.sum()], np.uint64) + np.array([band], np.uint64) * _M1))
            spare.append(0)
            continue
        n1, extra = bands.shape(band)
        parts = n1 * N2
        at = ((_mix(x ^ np.uint64(band)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(parts, np.uint64)
        np.add.at(total, at, _mix(x * _M1))
        count = np.bincount(at, minlength=parts).reshape(n1, N2)
        total = total.reshape(n1, N2)
        where = np.arange(n1, dtype=np.uint64) * _M2 + np.array([band], np.uint64) * _M1
        subsets = list(combinations(range(N2), N2 - K2))
        made, held = np.empty((len(subsets), n1), np.uint64), np.zeros((len(subsets), n1), np.int64)
        for j, chosen in enumerate(subsets):
            made[j] = where + np.uint64(j + 1)
            for c in chosen:
                made[j] = _mix(made[j] * _M1 + total[:, c])
                held[j] += count[:, c]
        some = held > 0
        gone = int((~some).sum())
        out.append(made[some] if gone <= extra else made.ravel())
        spare.append(max(0, extra - gone))
    return np.concatenate(out), min(spare)


def _identity(x: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(x.tobytes()) >> 1


def sketch(x: np.ndarray, buckets: int | None = None) -> bytes:
    """Parities of the elements' counts in a power of two of buckets, by default at least as many as elements."""
    m = buckets or 1 << max(6, len(x).bit_length())
    at = (_mix(x * _M3) & np.uint64(m - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketches_differ(p: bytes, q: bytes) -> int:
    """Bits in which two sketches differ, the larger folded to the size of the smaller."""
    if len(p) < len(q):
        p, q = q, p
    a, bits, to = int.from_bytes(p, "little"), 8 * len(p), 8 * len(q)
    while bits > to:
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ int.from_bytes(q, "little")).bit_count()


def wide_sketch(mark: Column, n: Column) -> Column:
    """From a set's mark, a sketch of WIDE to 2 * WIDE buckets an element; null if SKETCH has as many."""
    fit = F.when(F.size(mark) * 32 >= WIDE * n, folded(mark)).otherwise(mark)
    return F.when(WIDE * n > 64 * len(SKETCH), fit)


DESCRIBED = "doc_id long, k_id string, k_hash long, n long, node long, spare int, sigs array<long>, mark array<long>, " + ", ".join(f"{w} long" for w in SKETCH)


def _describe(batches: Iterator[pa.RecordBatch], k: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, k_id, k_hash, text) as DESCRIBED; of equal sets of a task, the first has signatures and sketch."""
    worker_cache("jaccard_join", _HASHES)
    seen: set[int] = set()
    for b in batches:
        for s in range(0, b.num_rows, 512):
            part = b.slice(s, 512)
            n, ident, spare, sigs, marks, words = [], [], [], [], [], []
            for text in part.column(3):
                x = shingle_set(text.as_py(), k)
                n.append(len(x))
                ident.append(_identity(x) if len(x) else None)
                if len(x) and ident[-1] not in seen:
                    if len(seen) < SEEN:
                        seen.add(ident[-1])
                    made, left = signatures(x, bands)
                    spare.append(left)
                    sigs.append(made.view(np.int64))
                    marks.append(np.frombuffer(sketch(x), np.int64))
                    words.append(np.frombuffer(sketch(x, 64 * len(SKETCH)), np.int64))
                else:
                    spare.append(0)
                    sigs.append(np.empty(0, np.int64))
                    marks.append(None)
                    words.append(np.zeros(len(SKETCH), np.int64))
            ends = np.cumsum([0, *map(len, sigs)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sigs), pa.int64()))
            columns = [pa.array(n, pa.int64()), pa.array(ident, pa.int64()), pa.array(spare, pa.int32()), flat, pa.array(marks, pa.list_(pa.int64())), *map(pa.array, np.array(words).T)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *columns], [c.split()[0] for c in DESCRIBED.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 512):
            part = b.slice(s, 512)
            found = [shingle_set(t.as_py(), k) for t in part.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_identity(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "items"]
            )


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for p, q in zip(b.column(2), b.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
            both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["ca", "cb"]).filter(pa.array(keep, pa.bool_()))


def _plausible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for n, m, p, q in zip(*(b.column(i).to_pylist() for i in (4, 5, 6, 7)), strict=True):
            most = (n + m) * (100 - percent) // (100 + percent)
            keep.append(100 * min(n, m) >= percent * max(n, m) and sketches_differ(*(np.array(v, np.int64).tobytes() for v in (p, q))) <= most)
        yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)], ["a", "b", "ca", "cb"]).filter(pa.array(keep, pa.bool_()))


class _Texts:
    """What verification reads: each node's sketch, and its set from the text of one row that has it."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, repeated: bool, shingle: int, percent: int):
        self.texts, self.nodes, self.repeated, self.shingle, self.percent = texts, nodes, repeated, shingle, percent

    def linked(self, pairs: DataFrame) -> DataFrame:
        """(ca, cb) of those of the pairs (a, b, ca, cb, na, nb) whose sets link."""
        percent, shingle = self.percent, self.shingle

        def plausible(batches):
            yield from tidy(_plausible(batches, percent))

        def to_sets(batches):
            yield from tidy(_sets(batches, shingle))

        def verify(batches):
            yield from tidy(_verify(batches, percent))

        shrink_executors(pairs.sparkSession)
        side = lambda x, m: self.nodes.select(F.col("node").alias(x), F.col("mark").alias(m))
        both = pairs.join(side("a", "ma"), "a").join(side("b", "mb"), "b").select("a", "b", "ca", "cb", "na", "nb", "ma", "mb")
        left = materialize(both.mapInArrow(plausible, "a long, b long, ca long, cb long"), "plausible")
        ends = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        key = ["k_id", "k_hash"]
        wanted = materialize(self.nodes.join(ends, "node", "left_semi").select(*key).distinct(), "wanted")
        sets = filtered_by_keys(self.texts, wanted, key, "left_semi").select("text").mapInArrow(to_sets, "node long, items binary")
        sets = materialize(sets.dropDuplicates(["node"]) if self.repeated else sets, "items")
        full = left.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        full = full.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("ca", "cb", "x", "y")
        out = materialize(full.mapInArrow(verify, "ca long, cb long"), "links")
        discard(left, wanted, sets)
        return out


def _without_frequent(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, n) of members (key, node, many) but for each node's most frequent signatures, as many as it may spare."""
    known = members.join(nodes.select("node", "n", "spare"), "node")
    often = Window.partitionBy("node").orderBy(F.desc("many")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    hot = known.filter(F.col("many") >= FREQUENT).withColumn("ahead", F.count("*").over(often)).filter("ahead > spare")
    return known.filter(F.col("many") < FREQUENT).select("key", "node", "n").unionByName(hot.select("key", "node", "n"))


def _rooted(docs: DataFrame, *parameters) -> DataFrame:
    with small_batches(docs.sparkSession):
        return _connected(docs, *parameters)


def _connected(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """One row per row of docs: doc_id, k_id, k_hash, n, root; rows with an equal root are connected, null: no words."""
    bands = Bands(percent)
    spark = docs.sparkSession

    def describe(batches):
        yield from tidy(_describe(batches, shingle, bands))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    shrink_executors(spark)
    described = materialize(texts.mapInArrow(describe, DESCRIBED), "described")
    sample = described.filter(F.pmod(F.xxhash64("k_id", "k_hash"), F.lit(SAMPLE)) == 0).select(F.explode("sigs").alias("key"))
    hot, parts = hot_keys(sample, SAMPLE), []
    for number in range(PASSES):
        rows = described.select(F.explode("sigs").alias("key"), "node").filter(F.pmod("key", F.lit(PASSES)) == number)
        parts.append(materialize(shared_keys(rows, hot).distinct(), "shared"))
        release(spark)
    shared = reduce(DataFrame.unionByName, parts)
    flat = materialize(described.drop("sigs"), "sets")
    discard(described)
    release(spark)
    shrink_executors(spark)
    row = F.min(F.struct("k_id", "k_hash"))  # one row for each node in question
    nodes = flat.filter("node is not null").join(shared.select("node").distinct(), "node", "left_semi").groupBy("node")
    nodes = nodes.agg(row.alias("row"), F.max("n").alias("n"), F.max("spare").alias("spare"), F.max(F.struct("mark", *SKETCH)).alias("marked"))
    nodes = materialize(nodes.select("node", "row.k_id", "row.k_hash", "n", "spare", "marked.*"), "nodes")
    kept = materialize(_without_frequent(shared, nodes), "kept")
    discard(*parts)
    release(spark)
    members = materialize(one_key_per_set(kept), "members")
    discard(kept)
    release(spark)
    repeated = not flat.groupBy("k_id", "k_hash").count().filter("count > 1").isEmpty()
    found = classes(members, _Texts(texts, nodes, repeated, shingle, percent).linked, percent / 100, nodes.select("node", *SKETCH, wide_sketch(F.col("mark"), F.col("n")).alias("wide")))
    out = flat.join(found, "node", "left").select("doc_id", "k_id", "k_hash", "n", F.coalesce("component", "node").alias("root"))
    out = materialize(out, "rooted")
    discard(nodes, members, flat)
    release(spark)
    return out


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id reachable by links).

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct word
    shingles; equal sets always link, empty sets (null, empty or blank texts) link with nothing and are their
    own component. Rows without an id link like others, but have no id to name a component: it is null if no
    row of it has one. Rows with equal ids and different texts are judged apart, repeated rows each get a row.
    An empty table gives an empty result. Other columns are not read. Sets are told apart by 63-bit hashes.
    """
    rooted = _rooted(docs, id_col, text_col, shingle, percent)
    names = materialize(rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("name")), "names")
    return rooted.join(names, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, the one of the smallest id, in its own columns.

    Rows are dropped by id and text together, so other texts under a dropped row's id stay. Null ids rank last, of
    equal ids the smaller text hash stays, and of rows repeated in id and text one. Rows without words (null, empty
    or blank texts) all stay. An empty table gives an empty result.
    """
    key = ["k_id", "k_hash"]
    rooted = _rooted(docs, id_col, text_col, shingle, percent).filter("root is not null")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k_id", "k_hash")
    heads = materialize(rooted.groupBy("root").agg(F.min(place).alias("head"), F.count("*").alias("size")).filter("size > 1"), "heads")
    judged = rooted.join(heads, "root").withColumn("stays", (F.col("k_id") == F.col("head.k_id")) & (F.col("k_hash") == F.col("head.k_hash")))
    judged = materialize(judged.groupBy(*key, "stays").count(), "near_copies")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(id_col, text_col))
    rest = filtered_by_keys(keyed, materialize(judged.filter("not stays").select(*key), "dropped"), key, "left_anti")
    again = materialize(judged.filter("stays and count > 1").select(*key), "repeated")
    if again.isEmpty():
        return rest.select("row.*")
    one = filtered_by_keys(rest, again, key, "left_semi").dropDuplicates(key)
    return filtered_by_keys(rest, again, key, "left_anti").unionByName(one).select("row.*")
