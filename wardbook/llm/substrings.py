"""Suffix-array dedup of bytes: suffixes are range-partitioned by leading bytes and sorted in their buckets."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm.repeats import GIANT, PART_BYTES, Elements, Unit, batches_of, remove_repeats
from wardbook.llm.support import table

WINDOW = 50
SEED = 20
SAMPLE_DOCUMENTS = 2000
"""Documents, about, that splitters are sampled from."""
SAMPLE_SEEDS = 64
"""Suffixes sampled of each."""

_CODES = np.random.default_rng(50).integers(0, 2**64, 256, np.uint64)


def split_bytes(texts: list[bytes]) -> Elements:
    buffer = b"".join(texts)
    return Elements(_CODES[np.frombuffer(buffer, np.uint8)], np.array([len(t) for t in texts]), buffer)


BYTES = Unit(split_bytes, WINDOW, SEED)


def splitters(docs: DataFrame, buckets: int) -> list[bytes]:
    """Leading bytes that cut a sample of suffixes into ``buckets`` ranges; the sample has a fixed bound."""
    docs = docs.filter("doc_id is not null")
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, docs.count()))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)

    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seeds = []
            for batch in batches_of(frame, BYTES):
                order = np.argsort(batch.runs.seed, kind="stable")
                doc, count = batch.runs.doc[order], {}
                for at, d in zip(batch.runs.anchor[order].tolist(), doc.tolist(), strict=True):
                    count[d] = count.get(d, 0) + 1
                    if count[d] <= SAMPLE_SEEDS:
                        seeds.append(batch.elements.buffer[at : at + SEED])
            yield pd.DataFrame({"seed": seeds})

    rows = docs.filter(place < share).select("doc_id", "text").mapInPandas(sample, "seed binary").collect()
    leads = sorted(bytes(r["seed"]) for r in rows)
    return sorted({leads[len(leads) * b // buckets] for b in range(1, buckets)}) if leads else []


def multikey_groups(words: np.ndarray) -> np.ndarray:
    """A number for each row of ``words``, equal for equal rows, in the rows' order: multikey quicksort by columns.

    Rows are sorted by one word; only those that still tie are sorted by the next.
    """
    group = np.zeros(len(words), np.int64)
    active = np.arange(len(words))
    for column in range(words.shape[1]):
        if not len(active):
            break
        key = words[active, column]
        order = np.argsort(key)
        if column:
            # By group, and in it by the rank of the word: both fit into one number.
            ranked = key[order]
            rank = np.zeros(len(order), np.int64)
            rank[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1]))
            order = np.argsort(group[active] * (rank[order[-1]] + 1) + rank)
        rows, key, old = active[order], key[order], group[active][order]
        first = np.append(True, (old[1:] != old[:-1]) | (key[1:] != key[:-1]))
        start = np.flatnonzero(first)
        size = np.diff(np.r_[start, len(rows)])
        # A group keeps the number of its first place, so numbers stay in order and free for those it splits into.
        base = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        within = start - base[np.searchsorted(base, start, side="right") - 1]
        group[rows] = np.repeat(old[start] + within, size)
        active = rows[np.repeat(size > 1, size)]
    return group


def suffix_minima(texts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For each text a bit for each of its windows that starts in a text of a smaller document.

    Every window is a suffix cut off at the window's length. They are sorted, and equal neighbours
    share the smallest document.
    """
    buffer = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8).astype(np.uint64)
    eight = np.zeros(len(buffer) - 7, np.uint64)
    for i in range(8):
        eight |= buffer[i : len(buffer) - 7 + i] << np.uint64(8 * (7 - i))
    sizes = np.array([len(t) for t in texts])
    count = sizes - WINDOW + 1
    text = np.repeat(np.arange(len(texts)), count)
    bit = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(sizes) - sizes)[text] + bit
    words = np.stack([eight[at + 8 * i] for i in range(WINDOW // 8)] + [eight[at + WINDOW - 8]], axis=1)
    group = multikey_groups(words)
    _, group = np.unique(group, return_inverse=True)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, docs[text])
    hit = least[group] < docs[text]
    out = np.zeros(len(texts), np.uint32)
    np.bitwise_or.at(out, text[hit], np.uint32(1) << bit[hit].astype(np.uint32))
    return out


def _digests(frame: pd.DataFrame, found: Iterator[tuple]) -> pd.DataFrame:
    rows = []
    for row, elements, place, removed in found:
        text = np.frombuffer(elements.buffer, np.uint8)[place]
        n_removed = int(np.count_nonzero(removed))
        spans = int(removed[0]) + int(np.count_nonzero(removed[1:] > removed[:-1])) if n_removed else 0
        kept = (text[~removed] if n_removed else text).tobytes()
        rows.append((row, len(text), n_removed, spans, hashlib.sha256(kept).hexdigest(), kept))
    out = pd.DataFrame(rows, columns=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).set_index("row")
    return frame[["doc_id"]].reset_index(drop=True).astype({"doc_id": "Int64"}).join(out)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, part_bytes: int = PART_BYTES, giant: int = GIANT, with_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; ``with_bytes`` adds ``kept``, what stays.

    Every byte goes that lies in a 50-byte string which also starts in a document with a smaller
    ``doc_id``. A null text is empty. Rows that repeat a ``doc_id`` take nothing from each other;
    rows without one are kept whole, and remove nothing. Bytes may be cut within a
    character, so what stays is binary. Other columns are not read.

    The suffixes sorted are those whose 20-byte seed other documents have too, as runs. Splitters
    sampled from the corpus range-partition runs by the leading bytes of their seed: the
    windows of equal text lie in one range, so no boundary parts them. A bucket sorts the
    suffixes of runs that are not alike by multikey quicksort.
    """

    def place(buckets: int):
        cuts = splitters(docs, buckets)  # fewer than there are buckets
        return lambda seed: bisect.bisect_right(cuts, seed)

    def finish(frame: pd.DataFrame, found: Iterator[tuple]) -> pd.DataFrame:
        out = _digests(frame, found)
        return out if with_bytes else out.drop(columns="kept")

    schema = SCHEMA + (", kept binary" if with_bytes else "")
    return remove_repeats(docs, BYTES, place, suffix_minima, finish, schema, part_bytes, giant)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


SQL = """
with bytes as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), placed as (
    select doc_id, unnest(range(0, len(h) // 2)) as i, unnest([substr(h, 2 * x + 1, 100) for x in range(0, len(h) // 2)]) as part
    from bytes
), judged as (
    select doc_id, i, part[1:2] as byte, case when len(part) = 100 then part end as string from placed
), first as (
    select doc_id, i, byte, string is not null and min(doc_id) over (partition by string) < doc_id as repeated from judged
), marked as (
    select doc_id, i, byte,
           max(repeated::int) over (partition by doc_id order by i rows between 49 preceding and current row) as gone
    from first
), edges as (
    select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by i), 0) = 0 as opens from marked
), summed as (
    select doc_id, count(*) as n_bytes, sum(gone)::bigint as n_removed, sum(opens::int)::bigint as n_spans,
           coalesce(string_agg(byte, '' order by i) filter (where gone = 0), '') as kept
    from edges group by doc_id
)
select d.doc_id, coalesce(n_bytes, 0)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
       coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from documents d left join summed using (doc_id)
"""
