"""Language ID by prediction by partial matching: the language whose context tree codes a text shortest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.llm.support import table

ORDER = 4
"""Bytes of context of the deepest nodes; an event is a context and the byte after it, in the low bytes of a number."""
LANGUAGE_BYTES = 2_000_000
"""Bytes of text learned from for each language, about; documents in the order of a hash."""
LEAST_DOCUMENTS = 16
"""Documents learned from at least, where a language has them: of each, one in so many parts of the language's bytes counts."""
SLICES = 16
"""Evenly spaced slices that are learned of a text longer than that."""
STEPS = 16
"""Steps in which the hash's range is halved."""
TOTAL_BYTES = 128_000_000
"""Bytes learned from for all languages together, about."""
FOLDS = 4
HELD_OUT = 2
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_BATCH = 1 << 20


def events(text: bytes) -> np.ndarray:
    """For each byte the number made of the ``ORDER`` bytes before it (zeros before the text) and itself."""
    padded = np.frombuffer(b"\0" * ORDER + text, np.uint8).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for back in range(ORDER + 1):
        out |= padded[ORDER - back : ORDER - back + len(text)] << np.uint64(8 * back)
    return out


@dataclass
class Level:
    """One depth of all context trees: a hash table of events, and for each the bits it costs in each language.

    ``escapes`` holds what leaving a context costs where the event is in no language's tree.
    """

    keys: np.ndarray
    slots: np.ndarray
    costs: np.ndarray
    context_keys: np.ndarray
    context_slots: np.ndarray
    escapes: np.ndarray


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _hash_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with linear probing: ``(stored keys, index of each)``, built in rounds of free slots."""
    bits = max(4, int(len(keys) * 2).bit_length())
    stored, index = np.full(1 << bits, np.uint64(2**64 - 1)), np.zeros(1 << bits, np.int32)
    at, left = (keys * _SPREAD) >> np.uint64(64 - bits), np.arange(len(keys))
    while len(left):
        free = stored[at[left]] == np.uint64(2**64 - 1)
        candidates = left[free]
        _, first = np.unique(at[candidates], return_index=True)
        won = candidates[first]
        stored[at[won]], index[at[won]] = keys[won], won
        left = left[~np.isin(left, won)]
        taken = stored[at[left]] != np.uint64(2**64 - 1)
        at[left[taken]] = (at[left[taken]] + np.uint64(1)) & np.uint64((1 << bits) - 1)
    return stored, index


def _find(keys: np.ndarray, stored: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The index of each key, -1 where it is not in the table."""
    mask = np.uint64(len(stored) - 1)
    at = (keys * _SPREAD) >> np.uint64(64 - (len(stored) - 1).bit_length())
    out = np.full(len(keys), -1, np.int64)
    left = np.arange(len(keys))
    while len(left):
        here = stored[at]
        hit = here == keys[left]
        out[left[hit]] = index[at[hit]]
        on = ~hit & (here != np.uint64(2**64 - 1))
        left, at = left[on], (at[on] + np.uint64(1)) & mask
    return out


def build(counts: pd.DataFrame, languages: list[str]) -> list[Level]:
    """Context trees of all orders from ``(language number, event, n)``, with escapes by method C.

    In a context that has seen n events of d kinds, one seen c times has c / (n + d)
    and the escape to the context one byte shorter d / (n + d). Below order 0 all
    256 bytes are equal. Statistics are frozen: the cost of an event is a number.
    """
    levels: list[Level] = []
    lang = counts["language"].to_numpy().astype(np.int64)
    for order in range(ORDER + 1):
        event = counts["event"].to_numpy().astype(np.uint64) & np.uint64((1 << 8 * (order + 1)) - 1)
        seen = pd.DataFrame({"l": lang, "e": event, "n": counts["n"].to_numpy()}).groupby(["l", "e"], as_index=False).sum()
        context = seen["e"].to_numpy() >> np.uint64(8)
        seen["c"] = context
        totals = seen.groupby(["l", "c"])["n"].agg(["sum", "size"]).reset_index()
        keys, contexts = np.unique(seen["e"].to_numpy()), np.unique(context)
        escapes = np.zeros((len(contexts), len(languages)))
        rows = np.searchsorted(contexts, totals["c"].to_numpy())
        escapes[rows, totals["l"]] = np.log2((totals["sum"] + totals["size"]) / totals["size"])
        lower = cost_of(keys & np.uint64((1 << 8 * order) - 1), levels, len(languages)) if order else 8.0
        costs = escapes[np.searchsorted(contexts, keys >> np.uint64(8))] + lower
        both = seen.merge(totals, on=["l", "c"])
        costs[np.searchsorted(keys, both["e"].to_numpy()), both["l"]] = np.log2((both["sum"] + both["size"]) / both["n"])
        levels.append(Level(*_hash_table(keys), costs, *_hash_table(contexts), escapes))
    return levels


def cost_of(event: np.ndarray, levels: list[Level], languages: int) -> np.ndarray:
    """Bits of each event in each language, from the deepest of ``levels`` down."""
    if not levels:
        return np.full((len(event), languages), 8.0)
    top = levels[-1]
    found = _find(event, top.keys, top.slots)
    out = top.costs[found]
    missing = np.flatnonzero(found < 0)
    if len(missing):
        rest = event[missing]
        context = _find(rest >> np.uint64(8), top.context_keys, top.context_slots)
        escape = np.where((context >= 0)[:, None], top.escapes[context], 0.0)
        shorter = rest & np.uint64((1 << 8 * (len(levels) - 1)) - 1)
        out[missing] = escape + cost_of(shorter, levels[:-1], languages)
    return out


def bits_of(text: bytes, levels: list[Level], languages: int) -> np.ndarray:
    """The exact code length of a text in each language, in bits."""
    total = np.zeros(languages)
    for at in range(0, len(text), _BATCH):
        piece = events(text[max(0, at - ORDER) : at + _BATCH])[min(at, ORDER) :]
        total += cost_of(piece, levels, languages).sum(axis=0)
    return total


def fold(ids: Column) -> Column:
    return F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def _slices(text: Column, most: int) -> Column:
    """The bytes of a text; of one over ``most`` about so many, in slices, all but the first after the ``ORDER`` bytes before them."""
    data, long, part = text.cast("binary"), F.octet_length(text).cast("long"), max(1, most // SLICES)

    def at(i: Column) -> Column:
        start = F.floor(i * (long - part) / (SLICES - 1)).cast("int")
        return F.substring(data, F.greatest(start - ORDER, F.lit(0)) + 1, F.lit(part + ORDER))

    slices = F.transform(F.sequence(F.lit(1), F.lit(SLICES - 1)), at)
    return F.when(long <= most, F.array(data)).otherwise(F.concat(F.array(F.substring(data, F.lit(1), F.lit(part))), slices))


@dataclass
class LanguageModel:
    languages: list[str]
    levels: list[Level]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the shortest code, ties to the first by name, and its probability among all languages.

        The probability takes every language as equally likely beforehand.
        """
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        bits = bits_of(text.encode(), self.levels, len(self.languages))
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(bits[best] - bits).sum())


def train(docs: DataFrame, language_bytes: int = LANGUAGE_BYTES, total_bytes: int = TOTAL_BYTES) -> LanguageModel:
    """Context trees of every language of documents outside the held-out fold.

    Each language takes its documents in the order of a hash of id and text until they
    come to ``language_bytes``, or to its part of ``total_bytes`` where there are many
    languages; the last step of hashes, about 4 % of that, is taken whole. Of a text only
    ``LEAST_DOCUMENTS``-th of these bytes count: a longer one gives evenly spaced slices. So
    every language with a text that is not empty is learned, from ``LEAST_DOCUMENTS``
    documents at least or from all it has. Counting is a Spark aggregation; what is
    collected is bounded by the bytes and, per language, the steps of the hash.
    """
    usable = docs.filter("lang is not null and text != ''").filter(
        F.coalesce(fold(F.col("doc_id")) != HELD_OUT, F.lit(True))
    )
    languages = sorted(r["lang"] for r in usable.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], [])
    each = max(1, min(language_bytes, total_bytes // len(languages)))
    most = max(1, each // LEAST_DOCUMENTS)
    number = {name: i for i, name in enumerate(languages)}
    place = (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) + 1) / float(1 << 53)
    stepped = usable.select("lang", "text", F.floor(F.log2(place) * STEPS).cast("int").alias("step"))
    size = F.least(F.octet_length("text"), F.lit(most)).cast("long")
    steps = stepped.groupBy("lang", "step").agg(F.sum(size).alias("bytes")).collect()
    taken: dict[str, int] = dict.fromkeys(languages, 0)
    last: dict[str, int] = {}
    for r in sorted(steps, key=lambda r: r["step"]):
        if taken[r["lang"]] < each:
            taken[r["lang"]] += r["bytes"]
            last[r["lang"]] = r["step"]
    cuts = docs.sparkSession.createDataFrame(list(last.items()), "lang string, last int")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by_language: dict[str, list[np.ndarray]] = {}
            for lang, slices in zip(batch["lang"], batch["slices"], strict=True):
                learned = [events(t)[ORDER if i else 0 :] for i, t in enumerate(slices)]
                by_language.setdefault(lang, []).extend(learned)
            for lang, found in sorted(by_language.items()):
                event, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"language": number[lang], "event": event.astype(np.int64), "n": n.astype(np.int64)})

    counts = (
        stepped.join(F.broadcast(cuts), "lang")
        .filter("step <= last")
        .select("lang", _slices(F.col("text"), most).alias("slices"))
        .mapInPandas(count, "language int, event long, n long")
        .groupBy("language", "event")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    return LanguageModel(languages, build(counts, languages))


def language_id(docs: DataFrame, language_bytes: int = LANGUAGE_BYTES) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Only the text decides. ``und`` with score 0 stands for a null text or one without a
    letter (Unicode category L: digits, number forms and marks are none), and for everything where nothing could be learned. Learning is from a bounded
    sample of every language (see ``train``); prediction reads whole texts. Rows that repeat a
    ``doc_id`` are predicted each; a null ``doc_id`` is never held out. Extra
    columns are not used.
    """
    spark = docs.sparkSession
    learned = train(docs, language_bytes)
    arrays = [tuple(vars(level).values()) for level in learned.levels]
    sent = spark.sparkContext.broadcast((learned.languages, arrays))  # bounded by TOTAL_BYTES

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, levels = sent.value
        model = LanguageModel(languages, [Level(*level) for level in levels])
        for batch in batches:
            found = [model.predict(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "held_out": batch["held_out"],
                    "lang_pred": [name for name, _ in found],
                    "score": [score for _, score in found],
                }
            )

    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInPandas(
        predict, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
