"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name by sorting
(the name is the number of the first such block), then adjacent names are paired and the pairs named in
the same way, level by level, until each document has one name. Names come from comparing contents, never
from hashes, so two documents have one identity only if their texts are equal.

A document that holds a block nobody else has is settled at once: that block's name is its identity.
The text is shuffled once; all later levels move integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, filtered_by_keys, materialize, partitions, row_key

BLOCK_BYTES = 4096


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    norm = docs.select(
        F.col(id_col).alias("doc_id"),
        ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"),
        *row_key(id_col, text_col),
    ).withColumn("rid", F.monotonically_increasing_id())
    whole = norm.select(
        "rid", "doc_id", "k_id", "k_hash",
        F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"),
        F.col("norm").cast("binary").alias("bytes"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / F.lit(block_bytes))).cast("int").alias("n"),
    )
    first = F.col("pos") == 0
    return whole.select(
        "rid", "doc_id", "k_id", "k_hash", "sha", "n", "bytes",
        F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"),
    ).select(
        "rid", "n", "pos",
        *[F.when(first, F.col(c)).alias(c) for c in ("doc_id", "k_id", "k_hash", "sha")],
        F.substring("bytes", F.col("pos") * block_bytes + 1, F.lit(block_bytes)).alias("block"),
        F.monotonically_increasing_id().alias("bid"),
    )


def _hot_blocks(docs: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    """Keys of blocks so frequent that their rows are dealt over several tasks, with how many.

    At most 4 x shuffle partitions keys can reach the threshold, which bounds the broadcast.
    """
    rows = _blocks(docs.select(F.lit(None).cast("long").alias("_i"), F.col(text_col).alias("_t")), "_i", "_t", block_bytes)
    counts = rows.groupBy(F.xxhash64("block").alias("h")).count()
    total = docs.agg(
        F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) / F.lit(block_bytes))))
    ).first()[0] or 1
    share = max(64, total // (4 * partitions(docs.sparkSession)))
    return counts.filter(F.col("count") >= share).select("h", F.ceil(F.col("count") / F.lit(share)).cast("int").alias("salts"))


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, k_id, k_hash, sha, n, name, shared; (n, name) is the text's identity.

    shared is false where no other row can have that identity.
    """
    hot = F.broadcast(_hot_blocks(docs, text_col, block_bytes))
    rows = _blocks(docs, id_col, text_col, block_bytes).withColumn("h", F.xxhash64("block"))
    rows = rows.join(hot, "h", "left").withColumn(
        "salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("bid"), F.col("salts"))).otherwise(F.lit(0))
    )
    same = Window.partitionBy("block", "salt")
    named = rows.withColumn("name", F.min("bid").over(same)).withColumn("cnt", F.count("*").over(same))
    lead_row = F.col("salts").isNotNull() & (F.col("bid") == F.col("name"))
    level0 = materialize(
        named.select("rid", "n", "pos", "doc_id", "k_id", "k_hash", "sha", "bid", "name", "cnt",
                     F.when(lead_row, F.col("block")).alias("lead")),
        "blocks",
    )
    leads = level0.filter("lead is not null").select("lead", "name", "cnt")
    merged = leads.join(leads.groupBy("lead").agg(F.min("name").alias("one"), F.sum("cnt").alias("all")), "lead")
    level0 = level0.drop("lead").join(merged.select("name", "one", "all"), "name", "left").select(
        "rid", "n", "pos", "doc_id", "k_id", "k_hash", "sha", "bid",
        F.coalesce("one", "name").alias("name"), F.coalesce("all", "cnt").alias("cnt"),
    )
    head = ["doc_id", "k_id", "k_hash", "sha", "n"]
    single = level0.filter("n = 1").select(*head, "name", (F.col("cnt") > 1).alias("shared"))
    several = level0.filter("n > 1").withColumn(
        "own", F.min(F.when(F.col("cnt") == 1, F.col("name"))).over(Window.partitionBy("rid"))
    )
    settled = several.filter("own is not null and pos = 0").select(*head, F.col("own").alias("name"), F.lit(False).alias("shared"))
    cur = materialize(several.filter("own is null").drop("own", "cnt"), "open")
    depth = cur.agg(F.max("n")).first()[0] or 1
    while depth > 1:
        even = F.col("pos") % 2 == 0
        pairs = cur.groupBy("rid", F.shiftright("pos", 1).alias("half")).agg(
            F.max(F.when(even, F.col("name"))).alias("l"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r"),
            F.min("bid").alias("bid"),
            *[F.max(c).alias(c) for c in head],
        ).withColumnRenamed("half", "pos")
        names = materialize(pairs.groupBy("l", "r").agg(F.min("bid").alias("name")), "pairs")
        cur, old = materialize(pairs.join(names, ["l", "r"]).drop("l", "r"), "level"), cur
        discard(names, old)
        depth = -(-depth // 2)
    return single.unionByName(settled).unionByName(cur.select(*head, "name", F.lit(True).alias("shared")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the row's k_id, k_hash.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty. Of equal texts the
    row with the largest id stays; rows that repeat that id are all marked kept (keep_exact leaves one).
    Null ids rank lowest; in a group of null ids only, keep_id is null and every row is marked kept.
    An empty table gives an empty result. Columns other than the two named ones are not read.
    """
    ids = materialize(block_identities(docs, id_col, text_col, block_bytes), "identities")
    once = ids.filter("not shared").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha", "k_id", "k_hash"
    )
    many = ids.filter("shared")
    groups = materialize(many.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    both = once.unionByName(many.join(groups, ["n", "name"]).select("doc_id", "keep_id", "group_size", "sha", "k_id", "k_hash"))
    return both.select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "k_id", "k_hash",
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without exact copies, in its own columns: one row of each group of equal texts."""
    rows = materialize(exact_groups(docs, id_col, text_col, block_bytes).select("kept", "text_sha256", "k_id", "k_hash"), "decisions")
    key = ["k_id", "k_hash"]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(id_col, text_col))
    rest = filtered_by_keys(keyed, materialize(rows.filter("not kept").select(*key).distinct(), "dropped"), key, "left_anti")
    # rows of one id whose texts are equal: all are marked kept, one stays
    again = rows.filter("kept").groupBy("text_sha256", "k_id").agg(F.count("*").alias("c"), F.min("k_hash").alias("k_hash")).filter("c > 1")
    again = materialize(again.select("text_sha256", *key), "repeated")
    if again.isEmpty():
        return rest.select("row.*")
    all_of = materialize(rows.join(again.select("text_sha256", "k_id"), ["text_sha256", "k_id"], "left_semi").select(*key).distinct(), "copies")
    one = filtered_by_keys(rest, again.select(*key), key, "left_semi").dropDuplicates(key)
    return filtered_by_keys(rest, all_of, key, "left_anti").unionByName(one).select("row.*")
