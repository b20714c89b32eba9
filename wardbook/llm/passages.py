"""Substring dedup of words: runs of 13-word windows with one anchor, compared where their anchors are shared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm.repeats import GIANT, PART_BYTES, Elements, Unit, remove_repeats
from wardbook.llm.support import table

WINDOW = 13
SEED = 6


class _Hashes(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def split_words(texts: list[bytes]) -> Elements:
    known = _Hashes()
    rows = [t.split() for t in texts]
    words = [w for row in rows for w in row]
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    high = np.cumsum(size + 1) - 1
    return Elements(hashes, np.array([len(row) for row in rows]), b" ".join(words), high - size, high)


WORDS = Unit(split_words, WINDOW, SEED)


def edge_minima(texts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For each path a bit for each of its edges (13 words) that starts in a path of a smaller document.

    The paths given branch: they share a seed and differ around it. They are unrolled into edges.
    """
    least: dict[bytes, int] = {}
    edges = []
    for text, doc in zip(texts, docs.tolist(), strict=True):
        words = text.split()
        own = [b" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
        edges.append(own)
        for edge in own:
            had = least.get(edge)
            if had is None or doc < had:
                least[edge] = doc
    return np.array(
        [
            sum(1 << bit for bit, edge in enumerate(own) if least[edge] < doc)
            for own, doc in zip(edges, docs.tolist(), strict=True)
        ],
        np.uint32,
    )


def _digests(frame: pd.DataFrame, found: Iterator[tuple]) -> pd.DataFrame:
    rows = []
    for row, elements, place, removed in found:
        low, high = elements.low[place], elements.high[place]
        if removed.any():
            stay = np.flatnonzero(~removed)
            kept = b" ".join(elements.buffer[a:b] for a, b in zip(low[stay].tolist(), high[stay].tolist(), strict=True))
        else:
            kept = elements.buffer[low[0] : high[-1]] if len(low) else b""
        rows.append((row, len(low), int(removed.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
    out = pd.DataFrame(rows, columns=["row", "n_words", "n_removed", "kept_sha256", "kept"]).set_index("row")
    return frame[["doc_id"]].reset_index(drop=True).astype({"doc_id": "Int64"}).join(out)


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def passage_dedup(docs: DataFrame, part_bytes: int = PART_BYTES, giant: int = GIANT, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row; ``with_text`` adds ``kept``, the words that stay.

    Every word goes that lies in a window of 13 words which also starts in a document with a
    smaller ``doc_id``; kept words are joined by one space. A null text has no words. Rows that
    repeat a ``doc_id`` take nothing from each other; rows without one are kept whole,
    and remove nothing. Other columns are not read.

    Successive windows with one anchor travel as a run; there is no graph of edges and nodes. Joined
    by anchor, a run whose anchor has one context is decided whole; of others the windows
    are compared one by one. The answers are joined back to the places in the source.
    """

    def finish(frame: pd.DataFrame, found: Iterator[tuple]) -> pd.DataFrame:
        out = _digests(frame, found)
        return out if with_text else out.drop(columns="kept")

    schema = SCHEMA + (", kept string" if with_text else "")
    return remove_repeats(docs, WORDS, None, edge_minima, finish, schema, part_bytes, giant)


def without_passages(docs: DataFrame, part_bytes: int = PART_BYTES, giant: int = GIANT) -> DataFrame:
    """``docs`` with the same columns, the words of ``passage_dedup`` gone from ``text``.

    A text that loses nothing stays as it is; of others the words that stay are joined by one space. ``n_chars``
    follows the text, if there is one. No row is dropped.
    """
    columns = [c for c in docs.columns if c not in ("doc_id", "text")]

    def finish(frame: pd.DataFrame, found: Iterator[tuple]) -> pd.DataFrame:
        texts = frame["text"].tolist()
        for row, elements, place, removed in found:
            if removed.any():
                low, high = elements.low[place][~removed].tolist(), elements.high[place][~removed].tolist()
                texts[row] = b" ".join(elements.buffer[a:b] for a, b in zip(low, high, strict=True)).decode()
        return frame[["doc_id", *columns]].assign(text=texts)[["doc_id", "text", *columns]].convert_dtypes()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", "text", *columns))
    out = remove_repeats(docs, WORDS, None, edge_minima, finish, schema, part_bytes, giant, tuple(columns))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(kinds["n_chars"]))
    return out.select(docs.columns)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(table(spark, sf_dir, "documents"))


SQL = """
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), placed as (
    select doc_id, len(w) as n, unnest(range(1, len(w) + 1)) as i, unnest(w) as word, w from words
), windows as (
    select doc_id, i, word, n, case when i + 12 <= n then array_to_string(w[i:i + 12], ' ') end as text from placed
), judged as (
    select doc_id, i, word,
           text is not null and min(doc_id) over (partition by text) < doc_id as repeated
    from windows
), marked as (
    select doc_id, i, word,
           coalesce(max(repeated::int) over (partition by doc_id order by i rows between 12 preceding and current row), 0) as gone
    from judged
), summed as (
    select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed,
           coalesce(string_agg(word, ' ' order by i) filter (where gone = 0), '') as kept
    from marked group by doc_id
)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from documents d left join summed using (doc_id)
"""
