"""Best-fit packing: partitions pack locally, and what stays underfull is merged up a tree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm.support import parts_for, table, written
from wardbook.llm.tokens import PACKING_VOCABULARY, vocabulary_ids

CAPACITY = 1024
END_ID = 2
PART_PIECES = 1 << 16
"""Pieces that one task packs."""
FAN_IN = 16
"""Partitions whose underfull sequences are merged in one task of the next round."""
_LOCAL_BITS = 26


def token_ids(text: str | None, vocabulary: str, end_id: int) -> np.ndarray:
    return np.append(vocabulary_ids(text or "", vocabulary), np.uint32(end_id)).astype("<u4")


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document; of a long one the first piece may be shorter."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def pieces_of(
    batches: Iterator[pd.DataFrame], capacity: int, vocabulary: str, end_id: int
) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            ids = token_ids(text, vocabulary, end_id)
            rows += [
                (doc, n, at, size, zlib.crc32(ids[at : at + size].tobytes()))
                for n, (at, size) in enumerate(cut(len(ids), capacity))
            ]
        frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        yield frame.astype({"doc_id": "Int64"})


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: the bin and offset of each item, and how full each bin is.

    Open bins are kept by their free room, with one bit for each room that some bin has.
    """
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            chosen, room = len(fill), capacity
            fill.append(0)
        bins[item], offsets[item] = chosen, fill[chosen]
        fill[chosen] += size
        left = room - size
        if left:
            by_room[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def carried(fill: np.ndarray, capacity: int, fan_in: int) -> np.ndarray:
    """Which bins go to the next round; all others are nearly full or of no further use.

    No two bins of a best-fit packing fit together, so at most one is half full
    or less. Two bins that fit together therefore include the half-full bin of some
    partition: a merge of ``fan_in`` partitions fills up ``fan_in`` bins at most,
    and the emptiest ones take whatever fuller ones would.
    """
    keep = fill * 2 <= capacity
    others = np.flatnonzero(~keep & (fill < capacity))
    keep[others[np.argsort(fill[others], kind="stable")[:fan_in]]] = True
    return keep


def pack_group(group: pd.DataFrame, level: int, capacity: int, fan_in: int, last: bool) -> pd.DataFrame:
    group = group.sort_values([c for c in ("length", "unit", "doc_id", "piece") if c in group], kind="stable")
    bins, offsets, fill = best_fit(group["length"].to_numpy(), capacity)
    keep = np.zeros(len(fill), bool) if last else carried(fill, capacity, fan_in)
    part = int(group["part"].iloc[0])
    return group.assign(
        bin=((level << 32 | part) << _LOCAL_BITS) + bins,
        offset=offsets,
        fill=fill[bins],
        carry=keep[bins],
    )


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str = PACKING_VOCABULARY,
    end_id: int = END_ID,
    part_pieces: int = PART_PIECES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """The pieces of all documents and their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text counts as empty, which is one token. Rows that repeat a ``doc_id``
    or have none are packed as documents of their own. Other columns are not read.

    Pieces are dealt out evenly; each partition packs its own by best fit and keeps back the few bins that a merge
    can still use (``carried``), which join those of ``fan_in - 1`` other partitions
    as the items of the next round, until one group is left.
    """

    def packer(level: int, last: bool):
        return lambda group: pack_group(group, level, capacity, fan_in, last)

    pieces = written(
        docs.select("doc_id", "text").mapInPandas(
            lambda batches: pieces_of(batches, capacity, vocabulary, end_id),
            "doc_id long, piece int, start long, length long, ids_crc32 long",
        )
    )
    parts = parts_for(pieces.count(), part_pieces)
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    schema = "length long, part int, bin long, offset long, fill long, carry boolean"
    level, last = 0, parts == 1
    placed = written(
        pieces.withColumn("part", deal)
        .groupBy("part")
        .applyInPandas(
            packer(level, last),
            f"doc_id long, piece int, start long, ids_crc32 long, {schema}",
        )
    )
    merged, units = [], placed
    while not last:
        level, parts = level + 1, parts_for(parts, fan_in)
        last = parts == 1
        items = (
            units.filter("carry")
            .groupBy(F.col("bin").alias("unit"), F.expr(f"part div {fan_in}").cast("int").alias("part"))
            .agg(F.max("fill").alias("length"))
        )
        units = written(
            items.groupBy("part").applyInPandas(
                packer(level, last),
                f"unit long, {schema}",
            )
        )
        merged.append(units)
    out = placed
    for moves in merged:
        move = moves.select(F.col("unit").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        out = out.join(move, "bin", "left").withColumns(
            {"bin": F.coalesce("to", "bin"), "offset": F.col("offset") + F.coalesce("by", F.lit(0))}
        ).drop("to", "by")
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )


def sequences(docs: DataFrame, places: DataFrame, vocabulary: str = PACKING_VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves, ``(sequence_id, ids)``, from ``pack``'s places; ``doc_id`` has to be unique."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [token_ids(t, vocabulary, end_id) for t in batch["text"]]
            yield batch.drop(columns="text").assign(
                ids=[
                    i[at : at + size].astype("int64").tolist()
                    for i, at, size in zip(ids, batch["start"], batch["length"], strict=True)
                ]
            )

    columns = ["doc_id", "start", "length", "sequence_id", "offset"]
    pieces = docs.select("doc_id", "text").join(places.select(columns), "doc_id")
    return (
        pieces.mapInPandas(
            read, "doc_id long, start long, length long, sequence_id long, offset long, ids array<long>"
        )
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
        .select("sequence_id", F.flatten("pieces.ids").alias("ids"))
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
