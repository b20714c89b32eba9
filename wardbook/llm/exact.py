"""Exact dedup over an extendible-hash index kept in the shared folder. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm.support import keyed, table, written

DEPTH_LIMIT = 16
"""Doublings at most: a directory has up to 2**16 entries, so it may be broadcast."""
BUCKET_KEYS = 1 << 16
"""Distinct keys a bucket holds before it is split."""


def _key(text: Column, hash_bits: int) -> Column:
    """The key of a text: 64 bits, or fewer in the upper part, so that different texts collide."""
    key = F.xxhash64(text)
    if hash_bits == 64:
        return key
    return key.bitwiseAND(F.lit((1 << hash_bits) - 1)) * F.lit(1 << (63 - hash_bits))


def _address(depth: int) -> Column:
    """The first ``depth`` bits of the 16-bit address of a key."""
    return F.expr(f"cell >> {DEPTH_LIMIT - depth}")


def directory(cells: DataFrame, bucket_keys: int) -> DataFrame:
    """``(cell, bucket, depth)``: the bucket each 16-bit address belongs to, ``depth`` being its local depth.

    Starts with one bucket. While a bucket holds more than ``bucket_keys``
    keys the directory doubles and the overfull buckets split by one more bit;
    buckets that fit keep their depth. A bucket is named by the first address
    in it, so names follow the order of the keys.
    """
    entries = cells.withColumns({"depth": F.lit(0), "bucket": F.lit(0).cast("long")})
    for depth in range(1, DEPTH_LIMIT + 1):
        load = entries.groupBy("bucket").agg(F.sum("keys").alias("load"))
        full = load.filter(F.col("load") > bucket_keys)
        if full.isEmpty():
            break
        entries = written(
            entries.join(F.broadcast(load), "bucket").select(
                "cell",
                "keys",
                F.when(F.col("load") > bucket_keys, F.lit(depth)).otherwise(F.col("depth")).alias("depth"),
                F.when(F.col("load") > bucket_keys, _address(depth) * (1 << (DEPTH_LIMIT - depth)))
                .otherwise(F.col("bucket"))
                .alias("bucket"),
            )
        )
    return entries.select("cell", "bucket", "depth")


def index(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, hash_bits: int = 64) -> DataFrame:
    """The index: a table ``(bucket, key, doc_id, text_sha256)`` in the shared folder, in ranges of keys.

    Entries are cut into ranges by bucket, key and document, so that a key that
    holds a third of all rows spreads over many owner tasks.
    """
    text = F.coalesce("text", F.lit(""))
    entries = written(docs.select(_key(text, hash_bits).alias("key"), "doc_id", F.unhex(F.sha2(text, 256)).alias("digest")))
    cell = F.shiftrightunsigned("key", 64 - DEPTH_LIMIT)
    cells = written(entries.select("key").distinct().groupBy(cell.alias("cell")).agg(F.count("*").alias("keys")))
    pages = directory(cells, bucket_keys)
    return written(
        entries.withColumn("cell", cell)
        .join(F.broadcast(pages), "cell")
        .select("bucket", "key", "doc_id", F.lower(F.hex("digest")).alias("text_sha256"))
        .repartitionByRange("bucket", "key", "doc_id")
        .sortWithinPartitions("bucket", "key", "doc_id")
    )


def exact_duplicates(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, hash_bits: int = 64) -> DataFrame:
    """Groups of documents with equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``, a row per row read.

    A null text counts as empty. Of equal texts the largest ``doc_id`` is kept.
    Rows that repeat both ``doc_id`` and text are members of one group and share
    its decision; a null ``doc_id`` is never kept, and ``keep_id`` is null where a
    group has no other. Other columns of ``docs`` are not read.

    Owner tasks first count the entries of each key in the index. Only keys with
    several entries have a chain: their texts are read again, compared as bytes by
    grouping on key and text (combined before the shuffle), and each link of the
    chain gets its keeper. A key whose chain has one link decides by the key
    alone; where different texts collide, the text is compared once more.
    ``hash_bits`` narrows the key, which tests use to force collisions.
    """
    entries = index(docs, bucket_keys, hash_bits)
    chains = written(entries.groupBy("key").count().filter("count > 1").select("key"))
    text = F.coalesce("text", F.lit(""))
    chained = keyed(docs.select(_key(text, hash_bits).alias("key"), "doc_id", text.alias("text")), chains, "left_semi")
    links = written(
        chained.groupBy("key", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("key", "keep_id", "group_size", F.sha2("text", 256).alias("link"), "text")
    )
    crowded = written(links.groupBy("key").count().filter("count > 1").select("key"))
    n_crowded = crowded.count()
    lone = links.drop("text", "link")
    single = entries
    if n_crowded:
        lone = keyed(lone, crowded, "left_anti", n_crowded)
        single = keyed(entries, crowded, "left_anti", n_crowded)
    out = single.join(lone, "key", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        "text_sha256",
    )
    if n_crowded:
        full = keyed(chained, crowded, "left_semi", n_crowded)
        out = out.union(
            full.join(links.select("key", "text", "keep_id", "group_size", "link"), ["key", "text"]).select(
                "doc_id", "keep_id", "group_size", F.col("link").alias("text_sha256")
            )
        )
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Rows without a ``doc_id`` cannot be told apart and stay. Of rows that repeat
    both ``doc_id`` and text one stays.
    """
    found = written(exact_duplicates(docs, bucket_keys).filter("doc_id is not null"))
    key = ["doc_id", "text_sha256"]
    drop = written(found.filter("not kept").select(key).distinct())
    marked = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
    rows = keyed(marked, drop, "left_anti")
    repeated = written(found.filter("kept").groupBy(key).count().filter("count > 1").select(key))
    count = repeated.count()
    if count:
        again = keyed(rows, repeated, "left_semi", count).dropDuplicates(key)
        rows = keyed(rows, repeated, "left_anti", count).unionByName(again)
    return rows.select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
select doc_id,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
