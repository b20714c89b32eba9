"""SimHash near-dedup: segment popcounts of fingerprints meet on a grid under Manhattan distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wardbook.llm.components import components
from wardbook.llm.support import keyed, table, written

SHINGLE = 4
MAX_BITS = 4
SEED = 42
_BLOCK = 1 << 16
_ODD = 0x5555555555555555


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    total = max(1, len(words) - SHINGLE + 1)
    ends = ends[min(SHINGLE, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, total, _BLOCK):
        spans = zip(starts[at : at + _BLOCK][: total - at].tolist(), ends[at : at + _BLOCK].tolist(), strict=False)
        hashes = np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total).view(">i8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint_of(text) for text in batch], dtype="int64")


def counts(bits: Column) -> Column:
    """Popcounts of the 32 two-bit segments, each in its own two bits (0, 1 or 2)."""
    low, high = bits.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_ODD))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def distance(x: Column, y: Column) -> Column:
    """Manhattan distance between two frames of segment popcounts: the differing bits of their unary codes."""

    def unary(c: Column) -> Column:
        return c.bitwiseOR(F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(_ODD)))

    return F.bit_count(unary(x).bitwiseXOR(unary(y)))


def _side(packed: Column, block: int) -> Column:
    """The popcounts of 16 segments: block 0 are the upper, block 1 the lower ones."""
    return F.shiftrightunsigned(packed, 32) if block == 0 else packed.bitwiseAND(F.lit(0xFFFFFFFF))


def grid(prints: DataFrame) -> DataFrame:
    """``(cell, fp)``: every grid point within Manhattan distance 1 of a fingerprint's popcounts, in each block."""
    field = F.col("field")
    step = F.call_function("shiftleft", F.lit(1).cast("long"), (F.abs(field) - 1) * 2)
    value = F.call_function("shiftright", F.col("own"), (F.abs(field) - 1) * 2).bitwiseAND(F.lit(3))
    cell = (
        F.when(field == 0, F.col("own"))
        .when((field > 0) & (value < 2), F.col("own") + step)
        .when((field < 0) & (value > 0), F.col("own") - step)
    )
    packed = counts(F.col("fp"))
    blocks = F.array(
        *(F.struct(F.lit(b).cast("long").alias("block"), _side(packed, b).alias("own")) for b in (0, 1))
    )
    return (
        prints.select("fp", F.explode(blocks).alias("b"))
        .select("fp", "b.block", "b.own", F.explode(F.sequence(F.lit(-16), F.lit(16))).alias("field"))
        .select((F.col("block") * (1 << 32) + cell).alias("cell"), "fp")
        .filter("cell is not null")
    )


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints that differ in ``max_bits`` (4 at most) bits or fewer, once each.

    Bits that differ within a segment change its popcount by no more than their
    number, so popcounts of linked fingerprints are within Manhattan distance 4,
    and within 2 in one of two blocks of 16 segments. Both sides visit the grid
    points within distance 1 of their own and so share one. Every pair is taken
    at one of its shared points, in the first block where it is near, and only if
    the whole Manhattan distance and then the fingerprints themselves are.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("two blocks meet within distance 2: max_bits is 4 at most")
    points = grid(prints)
    left = points.select("cell", F.col("fp").alias("a"))
    right = points.select("cell", F.col("fp").alias("b"))
    ca, cb = counts(F.col("a")), counts(F.col("b"))
    block = F.shiftright("cell", 32)
    at = F.col("cell").bitwiseAND(F.lit(0xFFFFFFFF))
    xa = F.when(block == 0, _side(ca, 0)).otherwise(_side(ca, 1))
    xb = F.when(block == 0, _side(cb, 0)).otherwise(_side(cb, 1))
    meets = (
        F.when(xa == xb, at == xa)
        .when((at == xa) | (at == xb), at == F.least(xa, xb))
        .otherwise(at * 2 <= xa + xb)
    )
    first = (block == 0) | (distance(_side(ca, 0), _side(cb, 0)) > 2)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    # Spark takes the grid for as small as the fingerprints it is made from, and would broadcast it.
    return (
        left.join(right.hint("merge"), "cell")
        .filter((F.col("a") < F.col("b")) & near & (distance(ca, cb) <= max_bits) & meets & first)
        .select("a", "b")
    )


def simhash_groups(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: the smallest ``doc_id`` reachable over links.

    A null or blank text has fingerprint zero and links like any other. Rows that
    repeat a ``doc_id`` each get a row; a null ``doc_id`` joins its group's
    component but never names one, so a group of null ids has a null
    component. Other columns are not read. Rows with equal fingerprints are one
    vertex of the graph, so copies never form pairs.
    """
    prints = written(docs.select("doc_id", fingerprint("text").alias("fp")))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    graph = components(links(classes.select("fp"), max_bits))
    grouped = classes.join(graph, classes["fp"] == graph["id"], "left").select(
        classes["fp"], F.coalesce("component_id", classes["fp"]).alias("root"), "low"
    )
    named = grouped.join(
        grouped.groupBy("root").agg(F.min("low").alias("component_id")), "root"
    ).select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group of ``simhash_groups``, the one with the smallest ``doc_id``, with all its columns.

    Rows without a ``doc_id`` stay, as they cannot be told apart. Rows that share one stay or go together.
    """
    groups = simhash_groups(docs, max_bits)
    drop = written(groups.filter("doc_id <> component_id").select("doc_id").distinct())
    return keyed(docs, drop, "left_anti")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
