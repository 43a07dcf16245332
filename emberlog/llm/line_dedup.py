"""Fuzzy line dedup by MinHash, in DataFrame operations only.

A line's features are its shingles of SHINGLE characters (of the trimmed, A-Z lower-cased line; a shorter line
is its own shingle). An order of the hashes of the distinct shingles is read as a circle, on which places are evenly
spread over the range of the hash: a band is the ROWS values that follow a place. A line of at least LONG shingles has
enough values for all BANDS places on the circle of the hashes themselves. For a shorter one, the KEEP smallest hashes
are put into independent orders, each by hashing them again, with RUNS places each, so that bands of one order hardly
overlap. A line that is long, but not too long to be like a short one, has the bands of both kinds. All of this happens
within a line's row. Equal lines meet before the bands are dealt out, and no text is shuffled for them.

Lines that share a band are candidates (cluster.py). Bit maps of their shingles rule out most of the pairs that aren't
similar; the others are verified by exact Jaccard of their shingle sets, and a distributed union-find joins the verified pairs. One line of each component stays: the first by document
id and line number. Two lines of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS or little
less; pairs that share a band are all judged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import SKETCH, _sketches_fit, classes, hot_keys, shared_keys
from .common import ascii_lower, discard, filtered_by_keys, materialize, release, row_key

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of the least similarity shares a band with probability 1 - (1 - 0.8**5)**16 = 0.998. Unrelated lines do so
#: with one that falls with ROWS; on much larger corpora raise it, and BANDS with it.
BANDS, ROWS = 16, 5
#: Bands of one order of a short line.
RUNS = 4
#: Hashes of a short line that its bands are taken from.
KEEP = 96
#: Distinct shingles from which on a line's bands come from one circle: then places are ten values apart on average.
LONG = 160
#: Words of 64 bits of a bit map of many buckets, and the shingles of a line from which on it has one beside a small one.
WIDE, WIDE_FROM = 16, 100
#: One line in so many tells which bands are so frequent that their rows are dealt over tasks.
SAMPLE = 64
#: Most candidate lines whose hashes (8 bytes each) are broadcast to pick out their texts; more are joined by shuffle.
BROADCAST_LINES = 2_000_000


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k_id, k_hash, doc_id, line_no, norm, h, g): the non-blank lines; (h, g) is the line's 128-bit identity."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), *row_key(id_col, text_col),
        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "line"),
    )
    norm = rows.select("doc_id", "k_id", "k_hash", "line_no", F.trim(ascii_lower(F.col("line"))).alias("norm")).filter("norm <> ''")
    return norm.withColumn("h", F.xxhash64("norm")).withColumn("g", F.xxhash64(F.lit(1), "norm", F.octet_length("norm")))


def _hashes(norm: Column) -> Column:
    """Hashes of a line's shingles, repeated ones too. In UTF-32 a shingle is cut out by its place, without a walk through the line."""
    wide = F.encode(F.when(F.char_length(norm) >= SHINGLE, norm), "UTF-32")
    shingle = lambda b, i: F.xxhash64(F.substring(b, i, F.lit(4 * SHINGLE)))
    each = lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - 4 * SHINGLE + 1, F.lit(4)), lambda i: shingle(b, i))
    found = F.element_at(F.transform(F.array(wide), each), 1)  # an array of one, so that the line is encoded once
    return F.coalesce(found, F.array(F.xxhash64(F.encode(norm, "UTF-32"))))


def _order(low: Column, k: int) -> Column:
    """The values of the k-th order, ascending."""
    return F.sort_array(F.transform(low, lambda v: F.xxhash64(v, F.lit(k))))


def _signatures(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per different line and kind of bands that it has: h, kind, its number of distinct shingles n, and bands b0, b1, ..."""
    sets = lines.select("h", F.array_distinct(_hashes(F.col("norm"))).alias("x")).withColumn("n", F.size("x").cast("long"))
    kinds = F.array_compact(F.array(F.when(F.col("n") < LONG / similarity, F.lit(0)), F.when(F.col("n") >= LONG, F.lit(1))))
    kinds = sets.select("h", "n", "x", F.explode(kinds).alias("kind"))
    spread = lambda parts: [i * (2**64 // parts) - 2**63 for i in range(parts)]
    low = F.when(F.col("kind") == 0, F.slice(F.sort_array("x"), 1, KEEP)).alias("low")
    mixed = F.when(F.col("kind") == 1, F.sort_array(F.concat("x", F.array(*map(F.lit, spread(BANDS)))))).alias("mixed")
    base = kinds.select("h", "n", "kind", low, mixed)
    count = -(-BANDS // RUNS)
    orders = base.select("h", "n", "kind", "mixed", *[_order(F.col("low"), k).alias(f"o{k}") for k in range(count)])
    places = spread(RUNS)[1:]
    mixtures = [F.sort_array(F.concat(f"o{k}", F.array(*map(F.lit, places)))).alias(f"m{k}") for k in range(count)]
    round_ = [F.concat(f"o{k}", F.slice(f"o{k}", 1, ROWS)).alias(f"o{k}") for k in range(count)]
    circles = orders.select("h", "n", "kind", F.concat("mixed", F.slice("mixed", 1, ROWS)).alias("circle"), *round_, *mixtures)
    short = []
    for k in range(count):
        # before the i-th place stand i - 1 other places and the values below it
        below = [F.lit(0), *[F.array_position(f"m{k}", F.lit(p)) - i for i, p in enumerate(places, 1)]]
        short += [F.xxhash64(F.slice(f"o{k}", (x + 1).cast("int"), ROWS), F.lit(k)) for x in below]
    # places stay among the values: where one comes within ROWS values, all lines have it
    long = [F.xxhash64(F.slice("circle", (F.array_position("circle", F.lit(p)) + 1).cast("int"), ROWS), F.lit(p)) for p in spread(BANDS)]
    bands = [F.when(F.col("kind") == 0, x).otherwise(y).alias(f"b{i}") for i, (x, y) in enumerate(zip(short[:BANDS], long, strict=True))]
    # a lambda function beside them keeps the bands out of one method of the whole stage, which would be too long to be compiled
    kind = F.element_at(F.transform(F.array("kind"), lambda k: k), 1).alias("kind")
    signed = circles.select("h", "n", kind, *bands)
    return signed.groupBy("h", "kind").agg(F.max("n").alias("n"), *[F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)])


def _bands(signed: DataFrame) -> DataFrame:
    """(key, node, n): a row for each band of a line."""
    return signed.select(F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("key"), F.col("h").alias("node"), "n")


def _bit_maps(texts: DataFrame) -> DataFrame:
    """(node, SKETCH, wide) of lines (h, norm): the buckets that a line's shingles fall into, as bits.

    Like parities, bits of two lines never differ in more places than their sets have differing elements.
    """
    wide = texts.select("h", F.encode("norm", "UTF-32").alias("b"))
    last = F.greatest(F.octet_length("b") - 4 * SHINGLE + 1, F.lit(1))
    each = wide.select("h", "b", F.explode(F.sequence(F.lit(1), last, F.lit(4))).alias("i"))
    hashed = each.select("h", F.xxhash64(F.substring(F.col("b"), F.col("i"), F.lit(4 * SHINGLE))).alias("v"))
    bit = hashed.select("h", F.expr(f"shiftright(v, 6) & {WIDE - 1}").alias("word"), F.expr("shiftleft(1L, cast(v & 63 as int))").alias("bit"))
    words = bit.groupBy("h").agg(F.count("*").alias("c"), *[F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"v{k}") for k in range(WIDE)])
    small = [reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"v{k}") for k in range(i, WIDE, len(SKETCH))]).alias(w) for i, w in enumerate(SKETCH)]
    return words.select(F.col("h").alias("node"), *small, F.when(F.col("c") >= WIDE_FROM, F.array(*[f"v{k}" for k in range(WIDE)])).alias("wide"))


def _linked(texts: DataFrame, maps: DataFrame, similarity: float):
    """Function from pairs (a, b, ca, cb, na, nb) to the (ca, cb) of those whose lines have the similarity, by exact Jaccard."""

    def linked(pairs: DataFrame) -> DataFrame:
        mapped = pairs
        for end in "ab":
            mapped = mapped.join(maps.select(F.col("node").alias(end), F.struct(*SKETCH, "wide").alias(f"of_{end}")), end)
        mapped = mapped.select(*pairs.columns, *[F.struct(F.col(f"n{end}").alias("n"), f"of_{end}.*").alias(f"of_{end}") for end in "ab"])
        near = materialize(mapped.filter(_sketches_fit("of_a", "of_b", similarity)).select(*pairs.columns), "near")
        ends = near.select(F.col("a").alias("h")).unionByName(near.select(F.col("b").alias("h"))).distinct()
        ends = materialize(ends, "ends")
        some = filtered_by_keys(texts, ends, ["h"], "left_semi", BROADCAST_LINES)
        both = near.join(some.select(F.col("h").alias("a"), F.col("norm").alias("x")), "a")
        both = both.join(some.select(F.col("h").alias("b"), F.col("norm").alias("y")), "b")
        common = F.size(F.array_intersect(_hashes(F.col("x")), _hashes(F.col("y"))))
        sized = both.select("ca", "cb", (F.col("na") + F.col("nb")).alias("both"), common.alias("common"))
        links = materialize(sized.filter(F.col("common") >= similarity * (F.col("both") - F.col("common")) - 1e-9).select("ca", "cb"), "links")
        discard(near, ends)
        return links

    return linked


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(h, root) for the lines that have a verified near copy: root is the component's smallest h, a 64-bit hash.

    Second, (h, g, k_id, k_hash, place, norm) of all lines, as a written table: texts of candidates only, made in the same pass.
    """
    lines = lines_of(docs, id_col, text_col)
    some = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.octet_length(F.col(text_col))), F.lit(SAMPLE)) == 0)
    hot = hot_keys(_bands(_signatures(lines_of(some, id_col, text_col), similarity)).select("key"), SAMPLE)
    members = materialize(shared_keys(_bands(_signatures(lines, similarity)), hot).select("key", "node", "n").distinct(), "members")
    release(docs.sparkSession)
    wanted = materialize(members.select(F.col("node").alias("h")).distinct(), "wanted")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k_hash", "line_no").alias("place")
    marked = wanted.withColumn("candidate", F.lit(True))
    named = lines.join(F.broadcast(marked) if wanted.count() <= BROADCAST_LINES else marked, "h", "left")
    named = materialize(named.select("h", "g", "k_id", "k_hash", place, F.when(F.col("candidate"), F.col("norm")).alias("norm")), "named")
    # where two lines have one h, either may answer for a pair
    texts = materialize(named.filter("norm is not null").select("h", "norm").distinct(), "lines")
    release(docs.sparkSession)
    maps = materialize(_bit_maps(texts), "maps")
    parts = classes(members, _linked(texts, maps, similarity), similarity, maps, False)
    discard(members, wanted, texts, maps)
    release(docs.sparkSession)
    return parts.select(F.col("node").alias("h"), F.col("component").alias("root")), named


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, dropped (line numbers from 0, ascending), k_id, k_hash.

    Lines are the parts between line feeds; blank ones are neither counted nor dropped. Of lines that are equal
    or connected by links of the similarity, the one of the smallest (id, line number) stays; of equal ids the text
    of the smaller hash comes first, and repeated rows of one document count as one place. Null ids come last. Null
    and empty texts have no lines. Lines of any length are read whole. An empty table gives an empty result. Other
    columns are not read. Near copies are known by a 64-bit hash of the line, equal lines by 128 bits.
    """
    parts, named = line_classes(docs, id_col, text_col, similarity)
    key = ["k_id", "k_hash"]
    lines = named.drop("norm")
    # lines that occur once and have no near copy need no place: counts alone are made for all lines
    counted = lines.groupBy("h", "g").count().join(parts, "h", "left").filter("root is not null or count > 1")
    counted = materialize(counted.select("h", "g", "root"), "counted")
    seen = lines.join(F.broadcast(counted) if counted.count() <= 200_000 else counted, ["h", "g"])
    rooted = seen.groupBy("h", "g", "root").agg(F.min("place").alias("first"))
    rooted = materialize(rooted.select("h", "g", "first", F.when(F.col("root").isNull(), F.struct("h", "g")).otherwise(F.struct(F.col("root").alias("h"), F.lit(0).cast("long").alias("g"))).alias("root")), "seen")
    stays = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    judged = materialize(rooted.join(stays, "root").select("h", "g", "stays"), "judged")
    discard(rooted)
    release(docs.sparkSession)
    gone = lines.join(F.broadcast(judged) if judged.count() <= 200_000 else judged, ["h", "g"]).filter("place <> stays")
    gone = gone.select(*key, F.col("place.line_no").alias("line_no")).distinct()
    gone = materialize(gone.groupBy(*key).agg(F.array_sort(F.collect_list("line_no")).alias("dropped")), "dropped")
    discard(judged, named)
    release(docs.sparkSession)
    blank = F.size(F.filter(F.split(F.coalesce("__t", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t"), *row_key(id_col, text_col))
    out = base.select("doc_id", *key, blank.cast("long").alias("n_lines")).join(gone, key, "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), *key)


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs in its own columns, with the dropped lines taken out of the texts.

    A null text stays null, a text of which every line is dropped becomes empty; repeated rows are treated alike;
    an empty table gives an empty result.
    """
    rows = dropped_lines(docs, id_col, text_col, similarity).filter("n_dropped > 0").select("k_id", "k_hash", "dropped")
    rows = materialize(rows.dropDuplicates(["k_id", "k_hash"]), "decisions")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(id_col, text_col))
    joined = keyed.join(rows, ["k_id", "k_hash"], "left")
    left = F.filter(F.split(F.col(f"row.`{text_col}`"), "\n"), lambda x, i: ~F.array_contains("dropped", i))
    text = F.when(F.col("dropped").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(left, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
