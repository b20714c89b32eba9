"""Byte-level BPE over overlapping chunks: chunks find common pre-token boundaries, the pieces between are encoded."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm.support import BROADCAST_ROWS, table, written
from wardbook.llm.tokens import ENCODING_VOCABULARY, PATTERN, rank_encoder, rank_ids

CHUNK = 1 << 15
OVERLAP = 1 << 10


def settled(character: str) -> bool:
    """Whether a character of any script has had its category since the tables of 2002, so that libraries agree on it."""
    category = unicodedata.ucd_3_2_0.category(character)
    return category != "Cn" and category == unicodedata.category(character)


def boundaries(text: str) -> set[int]:
    """Ends of the pre-tokens of a text that is cut off at its end, so without the last."""
    return {m.end() for m in regex.finditer(PATTERN, text)} - {len(text)}


def common_boundary(chunk: str, size: int) -> int | None:
    """Where a chunk of ``size`` characters and its overlap resynchronises with the chunk after it.

    Pre-tokens depend on what follows them, not on what precedes them. From the
    first place in the overlap that ends a pre-token in both readings, the one from
    the chunk's start and the one from the overlap's, the two agree. Only
    places between ``settled`` characters count, on which all Unicode tables agree.
    """
    overlap = boundaries(chunk[size:])
    found = [
        at
        for at in boundaries(chunk)
        if at >= size
        and (at - size in overlap or at == size)
        and settled(chunk[at - 1])
        and settled(chunk[at])
    ]
    return min(found, default=None)


def encode_all(batches: Iterator[pd.DataFrame], vocabulary: str) -> Iterator[pd.DataFrame]:
    """Whole texts: number of ids, and digests of the ids and of the bytes they decode to."""
    decode = rank_encoder(vocabulary).decode_bytes
    for batch in batches:
        ids = [rank_ids(text or "", vocabulary) for text in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"].astype("Int64"),
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(decode(i.tolist())).hexdigest() for i in ids],
            }
        )


def encode_pieces(batches: Iterator[pd.DataFrame], vocabulary: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = [rank_ids(t, vocabulary).astype("<u4").tobytes() for t in batch["text"]]
        yield batch.drop(columns="text").assign(ids=ids)


def assemble(pieces: pd.DataFrame, vocabulary: str) -> pd.DataFrame:
    """A long document from its encoded pieces; rows that repeat it give as many results."""
    copies = int((pieces["piece"] == pieces["piece"].min()).sum())
    ordered = pieces.drop_duplicates("piece").sort_values("piece")
    decode = rank_encoder(vocabulary).decode_bytes
    total, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()
    for ids in ordered["ids"]:
        numbers = np.frombuffer(ids, "<u4")
        total += len(numbers)
        ids_digest.update(ids)
        text_digest.update(decode(numbers.tolist()))
    row = (pieces["doc_id"].iloc[0], total, ids_digest.hexdigest(), text_digest.hexdigest())
    frame = pd.DataFrame([row] * copies, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return frame.astype({"doc_id": "Int64"})


def stitched(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """``(doc_id, key, piece, text)``: long texts, cut where neighbouring chunks resynchronise.

    Chunks are a table in the shared folder, dealt out evenly, so the chunks of one
    text are read by many tasks. Where an overlap has no common boundary there is no
    cut, and the piece goes on through the next chunk.
    """

    @F.pandas_udf("int")
    def cut_at(texts: pd.Series) -> pd.Series:
        return pd.Series([common_boundary(t, chunk) for t in texts], dtype="Int32")

    of = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), "text")
    longs = docs.withColumn("key", F.sha2(of, 256))
    count = F.ceil(F.char_length("text") / chunk).cast("int")
    chunks = written(
        longs.select("key", "text", F.explode(F.sequence(F.lit(0), count - 2)).alias("number"))
        .select("key", "number", F.expr(f"substring(text, number * {chunk} + 1, {chunk + overlap})").alias("text"))
        .repartition("key", "number")
    )
    cuts = written(
        chunks.select("key", (F.col("number") * chunk + cut_at("text")).alias("cut"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    )
    rows = cuts.agg(F.sum(F.size("cuts") + 4)).first()[0] or 0
    side = F.broadcast(cuts) if rows <= BROADCAST_ROWS else cuts
    begin, end = F.concat(F.array(F.lit(0)), "cuts"), F.concat("cuts", F.array(F.char_length("text")))
    return (
        longs.join(side, "key")
        .select("doc_id", "key", "text", F.posexplode(F.arrays_zip(begin.alias("b"), end.alias("e"))).alias("piece", "at"))
        .select("doc_id", "key", "piece", F.expr("substring(text, at.b + 1, at.e - at.b)").alias("text"))
    )


def byte_bpe(
    docs: DataFrame, vocabulary: str = ENCODING_VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded by a file of ranks and decoded again.

    A null text counts as empty and has no ids. Every row gets a row, also those
    that repeat a ``doc_id`` or have none. Other columns are not read. Texts up to
    ``chunk`` characters are one chunk. Longer ones are cut into chunks that
    overlap by ``overlap`` (less than ``chunk``), pre-tokenised in parallel, stitched
    where pre-token boundaries resynchronise, and the pieces between are encoded
    in parallel; digests run over a document's pieces in order. Scripts without spaces are cut at their punctuation;
    a text without any boundary within an overlap stays whole there.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    short = docs.filter(~long).select("doc_id", "text").mapInPandas(lambda b: encode_all(b, vocabulary), schema)
    pieces = (
        stitched(docs.filter(long).select("doc_id", "text"), chunk, overlap)
        .repartition("key", "piece")
        .mapInPandas(lambda b: encode_pieces(b, vocabulary), "doc_id long, key string, piece int, ids binary")
    )
    joined = pieces.groupBy("key").applyInPandas(lambda g: assemble(g, vocabulary), schema)
    return short.union(joined)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))
