"""Benchmark decontamination as a prefix-filtered set join.

A window is WINDOW consecutive words of a benchmark item (the whole item if it has fewer). Its features are
its shingles of SHINGLE consecutive words. Shingles are ordered by how often the corpus holds them, rarest
first. Containment must be whole, so a prefix of one shingle is necessary: a text that holds the window holds
its rarest shingle. Corpus positions meet the windows on that shingle, the window must fit the text around
it (length and position), and the words are then compared one by one.

Up to BROADCAST_WINDOWS windows the benchmark's prefix is broadcast: the corpus' positions are generated, joined
and verified within one stage. Beyond, positions are shuffled as (row key, position, hash of the shingle) alone,
and the words of a document are fetched once, for its candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, filtered_by_keys, materialize, row_key, word_array

WINDOW = 13
SHINGLE = 3
BROADCAST_WINDOWS = 200_000
#: Characters between words of lower-cased texts: ASCII other than 0-9 and a-z. Fixed values.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def words_of(text: Column) -> Column:
    return word_array(ascii_lower(text), SEPARATORS)


def _positions(words: str, k: int) -> list[Column]:
    """The k columns that, zipped, give each position of an array its next k words (null past the end)."""
    return [F.col(words) if i == 0 else F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))) for i in range(k)]


def _shingle_hash(cols: list[Column]) -> Column:
    return F.xxhash64(*cols)


def _at_positions(df: DataFrame, keep: list[str], words: str = "words") -> DataFrame:
    """A row for each word position: keep, pos (from 0) and key, the hash of the shingle that begins there."""
    zipped = F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(_positions(words, SHINGLE))])
    rows = df.select(*keep, F.posexplode(zipped).alias("pos", "z"))
    return rows.select(*keep, "pos", _shingle_hash([F.col(f"z.w{i}") for i in range(SHINGLE)]).alias("key"))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: win (array of words) with its number and the distinct items that hold it."""
    words = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))))
    rows = words.select("item_id", "words", start.alias("at"))
    return rows.select("item_id", F.slice("words", F.col("at"), window).alias("win")).distinct()


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_WINDOWS else df


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, k_id, k_hash.

    A word is hit if it lies inside any occurrence of a window; contaminated: n_hit > 0 and at least a
    twentieth of the words. Null or empty texts have no words, on either side. An item without an id can
    hit words but isn't among the items. Repeated rows each get a row. Empty tables give an empty result,
    or one without hits. Other columns are not read.
    """
    corpus = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"), *row_key(id_col, text_col))
    owned = materialize(benchmark_windows(items, item_id, item_text, window), "windows")
    wins = materialize(
        owned.select("win").distinct().withColumn("w", F.monotonically_increasing_id()).withColumn("len", F.size("win")), "win"
    )
    n_wins = wins.count()
    # a shingle that runs past the window's end is none of the window's; a window shorter than a shingle is its own
    pieces = _at_positions(wins, ["w", "len", "win"], "win").filter(F.col("pos") <= F.greatest(F.col("len") - SHINGLE, F.lit(0)))
    pieces = materialize(pieces, "pieces")
    long_keys = pieces.filter(F.col("len") >= SHINGLE).select("key").distinct()
    seen = _at_positions(corpus, []).join(_maybe_broadcast(long_keys, n_wins * window), "key").groupBy("key").count()
    ranked = pieces.join(materialize(seen, "seen"), "key", "left").filter("len < %d or count is not null" % SHINGLE)
    # a window with a shingle that no document has cannot occur, but it drops out by its rarest shingle anyway
    rare = F.row_number().over(Window.partitionBy("w").orderBy(F.coalesce("count", F.lit(0)), "pos"))
    whole = pieces.groupBy("w").agg(F.count("*").alias("all"))
    known = ranked.groupBy("w").agg(F.count("*").alias("known"))
    alive = whole.join(known, "w").filter("all = known").select("w")
    prefix = materialize(
        ranked.join(alive, "w", "left_semi").withColumn("rank", rare).filter("rank = 1").select("w", "len", "win", F.col("pos").alias("off"), "key"), "prefix"
    )
    n_prefix = prefix.count()
    long, short = prefix.filter(F.col("len") >= SHINGLE), prefix.filter(F.col("len") < SHINGLE)
    short = short.withColumn("word", F.col("win")[0])  # items of one or two words: the first word is the prefix
    kinds = [(lambda keep: _at_positions(corpus, keep), long, "key")]
    if not short.isEmpty():
        kinds.append((lambda keep: corpus.select(*keep, F.posexplode("words").alias("pos", "word")), short, "word"))
    hits = None
    for positions, wanted, on in kinds:
        found = _hits(corpus, positions, wanted, on, n_prefix)
        hits = found if hits is None else hits.unionByName(found)
    hits = materialize(hits, "hits")
    key = ["k_id", "k_hash"]
    order = Window.partitionBy(*key).orderBy("start", "end")
    spans = hits.groupBy(*key, "start").agg(F.max("end").alias("end"))
    until = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.col("end") - F.greatest(F.col("start"), until), F.lit(0)))
    covered = covered.groupBy(*key).agg(F.sum("new").alias("n_hit"))
    own = hits.select(*key, "w").distinct().join(wins, "w").join(owned, "win").filter("item_id is not null").select(*key, "item_id").distinct()
    own = own.groupBy(*key).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("list"))
    found = materialize(covered.join(own, key, "left"), "found")
    sized = corpus.select("doc_id", *key, F.size("words").cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    out = sized.join(found, key, "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")).cast("binary"), 256).alias("items_sha256"), *key,
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def _hits(corpus: DataFrame, positions, wanted: DataFrame, on: str, n_prefix: int) -> DataFrame:
    """Occurrences (k_id, k_hash, w, start, end) of the windows `wanted`, whose prefix a position has in column `on`.

    positions: function from the columns to keep to the corpus' rows by position, with pos and `on`.
    """
    key = ["k_id", "k_hash"]
    if n_prefix <= BROADCAST_WINDOWS:
        return _verified(positions([*key, "words"]).join(F.broadcast(wanted.select("w", "len", "win", "off", on)), on))
    met = positions(key).join(wanted.select("w", "off", on), on).filter("pos >= off").select(*key, "w", "pos", "off").distinct()
    met = materialize(met, "met")
    texts = filtered_by_keys(corpus.select(*key, "words"), materialize(met.select(*key).distinct(), "met_rows"), key, "left_semi")
    return _verified(met.join(wanted.select("w", "len", "win"), "w").join(texts.dropDuplicates(key), key))


def _verified(rows: DataFrame) -> DataFrame:
    """Occurrences (k_id, k_hash, w, start, end): candidates that fit and whose words are the window's."""
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("len") <= F.size("words"))
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win")
    return rows.filter(fits & same).select("k_id", "k_hash", "w", start.alias("start"), (start + F.col("len")).alias("end"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without its contaminated rows, in its own columns.

    Null and empty texts are never contaminated; repeated rows go or stay together; an empty table, or an empty
    benchmark, leaves docs as it is.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(id_col, text_col))
    bad = materialize(contamination(docs, items, id_col, text_col).filter("contaminated").select("k_id", "k_hash").distinct(), "bad")
    return filtered_by_keys(keyed, bad, ["k_id", "k_hash"], "left_anti").select("row.*")
