"""Classes of rows that share keys: what op5's signatures and op8's bands have in common.

A key says that its members may be similar. Members aren't paired all with all: every member is verified
against one representative of its key, verified pairs merge classes, and only keys that still hold several
classes come again, with another representative. The first representative of a key is its member with the
most company over all keys, which of copies is likely what they were copied from; later ones are drawn with
odds in proportion to that. As soon as few pairs are left, or a round settles little, every pair of members of
different classes is verified, dealt over blocks; parity sketches, if given, rule out most of them within the
join. Pairs inside a class that is known can't change the result, and a pair that shares many keys is judged at
one of them: each row knows the least keys of its node, and where two have one of these in common that comes before
the key at which they meet, they have met there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, release
from .graph import connected_components

STAR_ROUNDS = 5
#: Pairs for each member row that the last, exhaustive round may have for it to come before STAR_ROUNDS are over.
PAIRS_PER_ROW = 8
#: Share of its rows that a round must settle for another one like it.
PROGRESS = 0.1
#: Members of a key that one block of the last round holds on its left side.
BLOCK = 500
#: Columns of 64 bits each that make a sketch: the parities of a set's elements in as many buckets as they have bits.
SKETCH = ["w0", "w1", "w2", "w3"]
#: Parts of the keys of the last round that are judged one after the other if it has more rows than PART_ROWS: sketches are
#: dealt out with each row, and the shuffle files of a part are gone before the next.
PARTS, PART_ROWS = 2, 100_000
#: Keys of a node, the least ones, by which a pair is known to have met at an earlier key of the last round.
LEAST = 12
#: Fewest rows of a key that is dealt over several tasks.
HOT_ROWS = 4096


def hot_keys(sample: DataFrame, every: int) -> DataFrame | None:
    """(key, salts, many) of keys with more rows than a quarter of a task's share, from a sample of one row in `every`.

    key: the column of `sample`. At most 4 x shuffle partitions keys reach the share, which bounds the table. many
    estimates a key's rows. A key that the sample misses is merely not dealt out. None if there is no such key.
    """
    counts = materialize(sample.groupBy("key").count(), "sampled")
    rows = (counts.agg(F.sum("count")).first()[0] or 0) * every
    share = max(HOT_ROWS, rows // (4 * partitions(sample.sparkSession)))
    counts = counts.filter(F.col("count") * every >= share)
    hot = counts.select("key", F.ceil(F.col("count") * every / F.lit(share)).cast("int").alias("salts"), (F.col("count") * every).alias("many"))
    hot = materialize(hot, "hot")
    return None if hot.isEmpty() else F.broadcast(hot)


def shared_keys(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(key, node, many, and rows' other columns) of keys that two nodes or more have; many: rows of the key.

    Rows of hot keys are dealt over tasks by salt; as these keys are known to be shared, no task needs all their rows.
    """
    if hot is None:
        by = Window.partitionBy("key")
        counted = rows.withColumn("lo", F.min("node").over(by)).withColumn("hi", F.max("node").over(by)).withColumn("many", F.count("*").over(by))
        return counted.filter("lo <> hi").drop("lo", "hi")
    salt = F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")), F.lit(0).cast("bigint"))
    by = Window.partitionBy("key", "salt")
    counted = rows.join(hot, "key", "left").withColumn("salt", salt)
    counted = counted.withColumn("lo", F.min("node").over(by)).withColumn("hi", F.max("node").over(by)).withColumn("own", F.count("*").over(by))
    return counted.filter("lo <> hi or salts is not null").withColumn("many", F.coalesce("many", "own")).drop("lo", "hi", "own", "salt", "salts")


def one_key_per_set(members: DataFrame) -> DataFrame:
    """members (key, node, n) of the least key of those that have the same nodes, as further ones bring no other pairs.

    Sets of nodes are told apart by their sizes and 128 bits of hashes. Keys of a single node are left out. Both uses
    of members read the same columns, so that they are dealt out by key once.
    """
    members = members.filter("key is not null")  # the join asks for this too, without it here the two sides differ
    by = Window.partitionBy("key")
    sets = members.withColumns({"m": F.count("*").over(by), "lo": F.min("node").over(by)}).filter("m > 1")
    # hashes are made after that window, else they would be dealt out with the rows
    marks = {f"mark{seed}": F.bit_xor(F.xxhash64("node", "n", F.lit(seed))).over(by) for seed in range(2)}
    sets = sets.withColumns(marks).filter("node = lo")
    return members.join(sets.groupBy("m", "mark0", "mark1").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _size_fits(p: str, q: str, ratio: float) -> Column:
    n, m = F.col(f"{p}.n"), F.col(f"{q}.n")
    return F.least(n, m) >= ratio * F.greatest(n, m) - 1e-9


def _heads(live: DataFrame, spread: DataFrame, number: int, ratio: float) -> DataFrame:
    """Pairs (a, b, ca, cb, na, nb) of members with the representative of their key in this round."""
    company = F.sum("m").over(Window.partitionBy("one.node"))
    weighed = live.join(spread.select("key", "m"), "key").withColumn("company", company.cast("double"))
    luck = F.xxhash64("one.node", F.lit(number))
    odds = F.col("company") if not number else F.col("company") / -F.log((F.pmod(luck, F.lit(1 << 30)) + 1) / F.lit((1 << 30) + 1.0))
    heads = materialize(weighed.groupBy("key").agg(F.max(F.struct(odds.alias("odds"), "one.node", "one.n", "one.comp")).alias("head")), "heads")
    met = live.join(heads, "key").filter("one.comp <> head.comp").filter(_size_fits("one", "head", ratio))
    return _pairs(met, "one", "head")


def folded(words: Column) -> Column:
    """A sketch of half as many buckets, from the words of a sketch of a power of two of words."""
    half = (F.size(words) / 2).cast("int")
    return F.zip_with(F.slice(words, 1, half), F.slice(words, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _sketches_fit(p: str, q: str, ratio: float) -> Column:
    """Differing bits are never more than differing elements, and linked sets have few of these.

    Sets of many elements fill the buckets of SKETCH and have a wide one too; of two wide ones, the larger is folded
    once, and still larger ones tell nothing. Bit maps of the buckets in use serve as well, if all wide ones are of one size.
    """
    most = (F.col(f"{p}.n") + F.col(f"{q}.n")) * ((1 - ratio) / (1 + ratio)) + 1e-9
    bits = sum((F.bit_count(F.col(f"{p}.{w}").bitwiseXOR(F.col(f"{q}.{w}"))) for w in SKETCH), F.lit(0))
    x, y = F.col(f"{p}.wide"), F.col(f"{q}.wide")
    x, y = F.when(F.size(x) > F.size(y), folded(x)).otherwise(x), F.when(F.size(y) > F.size(x), folded(y)).otherwise(y)
    differ = F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, c: total + F.coalesce(c, F.lit(0)))
    return (bits <= most) & (F.col(f"{p}.wide").isNull() | F.col(f"{q}.wide").isNull() | (F.size(x) != F.size(y)) | (differ <= most))


def _judged(live: DataFrame, sketches: DataFrame) -> DataFrame:
    """Sketches of the nodes in `live`, and `least`: up to LEAST of a node's keys there, from the least up."""
    keys = live.select("key", F.col("one.node").alias("node"))
    first = keys.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("key"))).filter(F.col("place") <= LEAST)
    first = first.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("least"))
    return materialize(sketches.join(first, "node"), "judged")


def _all_pairs(live: DataFrame, spread: DataFrame, ratio: float, judged: DataFrame | None) -> DataFrame:
    """Pairs (a, b, ca, cb, na, nb) of all members of a key in different classes; crowded keys are dealt over blocks.

    judged: what _judged() says of the whole round; pairs are then made at the least key that they share, and at a later one only if
    that is not among the LEAST of both.
    """
    dealt = live.join(spread.select("key", F.ceil(F.col("m") / BLOCK).alias("blocks")), "key")
    if judged is not None:
        flat = dealt.select("key", "blocks", F.col("one.node").alias("node"), F.col("one.n").alias("n"), F.col("one.comp").alias("comp"))
        before = F.filter("least", lambda k: k < F.col("key")).alias("before")
        dealt = flat.join(judged, "node").select("key", "blocks", F.struct("node", "n", "comp", *SKETCH, "wide", before).alias("one"))

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        fits = (F.col("l.one.node") < F.col("r.one.node")) & (F.col("l.one.comp") != F.col("r.one.comp")) & _size_fits("l.one", "r.one", ratio)
        if judged is not None:
            fits = fits & _sketches_fit("l.one", "r.one", ratio) & ~F.arrays_overlap("l.one.before", "r.one.before")
        same = reduce(Column.__and__, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on])
        return left.alias("l").join(right.alias("r"), same & fits).select("l.one", F.col("r.one").alias("other"))

    rows = dealt.filter("blocks = 1").select("key", "one")
    pairs = met(rows, rows, ["key"])  # both sides are one exchange
    if not spread.filter(F.col("m") > BLOCK).isEmpty():
        crowded = dealt.filter("blocks > 1")
        left = crowded.select("key", "one", F.pmod(F.xxhash64("one.node"), F.col("blocks")).alias("block"))
        right = crowded.select("key", "one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        pairs = pairs.unionByName(met(left, right, ["key", "block"]))
    return _pairs(pairs, "one", "other")


def _all_pairs_in_parts(live: DataFrame, spread: DataFrame, ratio: float, judged: DataFrame, parts: int, tidy: Callable) -> DataFrame:
    found = []
    for number in range(parts):
        mine = F.pmod(F.xxhash64("key"), F.lit(parts)) == number
        found.append(materialize(_all_pairs(live.filter(mine), spread.filter(mine), ratio, judged), "pairs_of_part"))
        tidy(live.sparkSession)
    out = materialize(reduce(DataFrame.unionByName, found).distinct(), "pairs")
    discard(*found)
    return out


def _pairs(met: DataFrame, p: str, q: str) -> DataFrame:
    """Distinct pairs of the structs p and q: the smaller node a and the other b, their classes and sizes."""
    first = F.col(f"{p}.node") < F.col(f"{q}.node")
    side = lambda x, y, c: F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    names = {"": "node", "c": "comp", "n": "n"}
    return met.select(*[side(*(p, q) if end == "a" else (q, p), names[k]).alias(k + end) for k in names for end in "ab"]).distinct()


def classes(members: DataFrame, linked: Callable[[DataFrame], DataFrame], ratio: float, sketches: DataFrame | None = None, sparing: bool = True) -> DataFrame:
    """(node, component) of every node that has a link to another.

    members: distinct (key, node, n), keys with several nodes. linked: the (ca, cb) of those of the pairs (a, b, ca,
    cb, na, nb) that are verified, as a written table. ratio: the least Jaccard similarity of linked nodes, sets of n
    elements. sketches: (node, SKETCH, wide) of all nodes; wide: a sketch of more buckets for sets of many elements, else null.
    sparing: shuffle files go as soon as a step's result is written; else they stay till the caller releases them, for
    members that are few beside what was dealt out before, as each time costs a pause.
    """
    spark = members.sparkSession
    tidy = release if sparing else lambda _: None
    live = members.select("key", F.struct(F.col("node"), F.col("n"), F.col("node").alias("comp")).alias("one"))
    parts, old, before = None, [], None
    for number in range(STAR_ROUNDS + 1):
        square = lambda c: F.col(c).cast("double") * F.col(c)
        if number:
            counts = live.groupBy("key", F.col("one.comp").alias("comp")).count()
            spread = counts.groupBy("key").agg(F.sum("count").alias("m"), F.sum(square("count")).alias("own"), F.count("*").alias("classes"))
        else:  # each node is a class of its own
            spread = live.groupBy("key").agg(F.count("*").alias("m"), F.count("*").cast("double").alias("own"), F.count("*").alias("classes"))
        spread = spread.filter("classes > 1")
        spread = materialize(spread, "spread")
        rows, pairs_left = spread.agg(F.sum("m"), F.sum((square("m") - F.col("own")) / 2)).first()
        if not pairs_left:
            discard(spread, *old)
            break
        if number:
            live = materialize(live.join(spread.select("key"), "key", "left_semi"), "live")
        discard(*old)
        tidy(spark)
        few = pairs_left <= PAIRS_PER_ROW * rows or number > 1 and rows > (1 - PROGRESS) * before
        every, before = number == STAR_ROUNDS or number > 0 and few, rows
        judged = _judged(live, sketches) if every and sketches is not None else None
        if judged is not None and rows > PART_ROWS:
            pairs = _all_pairs_in_parts(live, spread, ratio, judged, PARTS, tidy)
        else:
            pairs = materialize(_all_pairs(live, spread, ratio, judged) if every else _heads(live, spread, number, ratio), "pairs")
        if judged is not None:
            discard(judged)
        tidy(spark)
        links = linked(pairs)
        discard(pairs)
        merged = materialize(connected_components(links, "ca", "cb"), "merged")
        if parts is None:
            parts = merged
        else:
            moved = merged.withColumnRenamed("component", "root").withColumnRenamed("node", "component")
            kept = parts.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            parts = materialize(kept.unionByName(merged.join(parts.select("node"), "node", "left_anti")), "parts")
        old = [live, spread]
        tidy(spark)
        if every:
            discard(*old)
            break
        moved = merged.select(F.col("node").alias("comp"), "component")
        live = live.select("key", F.col("one.node").alias("node"), F.col("one.n").alias("n"), F.col("one.comp").alias("comp")).join(moved, "comp", "left")
        live = live.select("key", F.struct(F.col("node"), F.col("n"), F.coalesce("component", "comp").alias("comp")).alias("one"))
    return parts if parts is not None else members.select("node", F.col("node").alias("component")).limit(0)
