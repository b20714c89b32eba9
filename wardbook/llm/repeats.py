"""Windows of fixed length that also start in a document with a smaller id, found exactly and in bounded pieces.

Both substring operators stand on this. Every window has an anchor: of the seeds
(shorter windows) inside it the one with the smallest hash, so equal windows have equal
anchors at the same place. Successive windows with one anchor form a run; there are about
fifteen windows to a run of bytes, and four to a run of words. Then, all messages being
packed by sender and receiver:

1. Parts (4 MB of documents each) tell each seed bucket which seeds they have, and learn which
   of them other documents have too. A window without such a seed is unique.
2. Parts send each different run with such a seed, as text, with its smallest document, to
   the run's bucket. The bucket compares texts and answers which windows of the run start in a smaller document.
   Seeds with very many runs are not kept together: their windows are sent one by one.
3. Parts mark the elements that those windows cover.

A part sends a run once, however many of its documents hold it, and a bucket gets it once from
each part, so a passage that a third of all documents share costs a row for each part.

Rows without an id take no part and go round all exchanges. Parts are dealt by id and text: rows of one id take
nothing from each other, so they need not meet. Only rows equal in both lie in one part, however many they are.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.support import parts_for, text_bytes

PART_BYTES = 4_000_000
GIANT = 100_000
"""Runs of one seed, in all documents, from which on its windows are dealt out one by one."""
_BATCH_BYTES = 1 << 20
_BLOCK = 1 << 15
"""Elements whose hashes are made at once: few enough to stay in a processor's cache."""
_MULTIPLIER = 0x9E3779B97F4A7C15
_ALL = np.uint32(2**32 - 1)


@dataclass
class Elements:
    """Documents as rows of elements: a hash of each, how many a document has, and their bytes.

    ``low`` and ``high`` bound each element in ``buffer``; where elements are bytes they are None.
    """

    hashes: np.ndarray
    lengths: np.ndarray
    buffer: bytes
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def bounds(self, first: np.ndarray, last: np.ndarray) -> tuple[list[int], list[int]]:
        """The bytes of the elements from ``first`` to ``last``, included."""
        if self.low is None:
            return first.tolist(), (last + 1).tolist()
        return self.low[first].tolist(), self.high[last].tolist()


@dataclass
class Runs:
    """Runs of windows of a batch: document, first window, number of windows, seed, and where the seed starts."""

    doc: np.ndarray
    first: np.ndarray
    size: np.ndarray
    seed: np.ndarray
    anchor: np.ndarray

    def pick(self, keep: np.ndarray) -> Runs:
        return Runs(self.doc[keep], self.first[keep], self.size[keep], self.seed[keep], self.anchor[keep])


@dataclass(frozen=True)
class Unit:
    """What an element is: ``split`` turns texts into ``Elements``; windows have ``window`` of them, seeds ``seed``."""

    split: Callable[[list[bytes]], Elements]
    window: int
    seed: int


@dataclass
class Batch:
    """About a megabyte of a part: its rows, their ids, elements without hashes, and runs."""

    rows: np.ndarray
    ids: np.ndarray
    elements: Elements
    runs: Runs


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` successive elements, by doubling."""

    def power(n: int) -> np.uint64:
        return np.uint64(pow(_MULTIPLIER, n, 1 << 64))

    out, have, step, length = None, 0, hashes, 1
    while size:
        if size & 1:
            if out is None:
                out, have = step, length
            else:
                n = len(hashes) - have - length + 1
                out = out[:n] * power(length)
                out += step[have : have + n]
                have += length
        size >>= 1
        if size:
            n = len(step) - length
            doubled = step[:n] * power(length)
            doubled += step[length : length + n]
            step = doubled
            length *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[: len(values) - span], values[span:])
        span *= 2
    if span < size:
        values = np.minimum(values[: len(values) - (size - span)], values[size - span :])
    return values


def runs_of(elements: Elements, unit: Unit) -> Runs:
    """All runs of a batch; its anchors are found block by block."""
    total = len(elements.hashes)
    ends = np.cumsum(elements.lengths)
    starts = ends - elements.lengths
    long = elements.lengths >= unit.window
    inside = np.zeros(total + 1, np.int8)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - unit.window + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    seeds = np.zeros(total, np.uint64)
    anchor = np.zeros(max(total - unit.window + 1, 0), np.int64)
    for at in range(0, len(anchor), _BLOCK):
        here = grams(elements.hashes[at : at + _BLOCK + unit.window - 1], unit.seed)
        seeds[at : at + len(here)] = here
        marked = (here & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(here), dtype=np.uint64)
        least = sliding_min(marked, unit.window - unit.seed + 1) & np.uint64(0xFFFFFF)
        anchor[at : at + len(least)] = least
        anchor[at : at + len(least)] += at
    anchor[~inside[: len(anchor)]] = -1
    first = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.append(np.zeros(min(len(anchor), 1), np.int64), first)
    size = np.diff(np.append(first, len(anchor)))
    known = anchor[first] >= 0
    first, size = first[known], size[known]
    return Runs(np.searchsorted(ends, first, side="right"), first, size, seeds[anchor[first]], anchor[first])


def batches_of(frame: pd.DataFrame, unit: Unit) -> list[Batch]:
    """The batches of a part; rows without an id have no runs."""
    texts = [(t or "").encode() for t in frame["text"]]
    known = frame["doc_id"].notna().to_numpy()
    ids = frame["doc_id"].fillna(0).astype("int64").to_numpy()
    out: list[Batch] = []
    rows: list[int] = []
    held = 0
    for row in range(len(texts) + 1):
        if rows and (row == len(texts) or held + len(texts[row]) > _BATCH_BYTES):
            elements = unit.split([texts[r] for r in rows])
            runs = runs_of(elements, unit)
            elements.hashes = elements.hashes[:0]
            at = np.array(rows)
            out.append(Batch(at, ids[at], elements, runs.pick(known[at[runs.doc]])))
            rows, held = [], 0
        if row < len(texts):
            rows.append(row)
            held += len(texts[row])
    return out


def seeds_of(batches: list[Batch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The seeds of a part in order, whether several of its documents have them, how many runs, and those runs' places."""
    seed = np.concatenate([np.zeros(0, np.uint64), *(b.runs.seed for b in batches)])
    doc = np.concatenate([np.zeros(0, np.int64), *(b.ids[b.runs.doc] for b in batches)])
    order = np.argsort(seed)
    if not len(seed):
        return seed, np.zeros(0, bool), np.zeros(0, np.int64), order
    seed, doc = seed[order], doc[order]
    start = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
    several = np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)
    return seed[start], several, np.diff(np.append(start, len(seed))), order


def tell_seeds(frame: pd.DataFrame, part: int, unit: Unit, bits: int) -> pd.DataFrame:
    """Messages of a part to the seed buckets: six bytes of each seed (beside the bucket), and its runs."""
    seed, _, count, _ = seeds_of(batches_of(frame, unit))
    bucket = (seed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(seed), np.int64)
    rows = []
    for b in np.unique(bucket):
        low, high = np.searchsorted(bucket, [b, b + 1])
        short = seed[low:high].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        rows.append((int(b), part, short.tobytes(), count[low:high].astype("<u4").tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "part", "seeds", "counts"])


def compare_seeds(messages: pd.DataFrame, giant: int) -> pd.DataFrame:
    """A seed bucket's answers: bit 0 of a seed's flag if other parts have it, bit 1 if it has too many runs.

    Six bytes may make different seeds equal; that costs a comparison later, and loses nothing.
    """
    short = [np.frombuffer(m, np.uint8).reshape(-1, 6) for m in messages["seeds"]]
    sizes = [len(s) for s in short]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :6] = np.concatenate(short)
    counts = np.concatenate([np.frombuffer(m, "<u4") for m in messages["counts"]])
    _, index, parts = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    runs = np.bincount(index, weights=counts)
    flags = ((parts > 1).astype(np.uint8) | ((runs > giant).astype(np.uint8) << 1))[index]
    cuts = np.split(flags, np.cumsum(sizes)[:-1])
    return pd.DataFrame(
        {"part": messages["part"].to_numpy(), "bucket": messages["bucket"].to_numpy(), "flags": [c.tobytes() for c in cuts]}
    )


@dataclass
class Shared:
    """Of each run of a part, batch after batch, whether several documents have its seed, and whether that has too many runs."""

    shared: list[np.ndarray]
    giant: list[np.ndarray]

    @classmethod
    def of(cls, batches: list[Batch], answers: pd.DataFrame) -> Shared:
        seed, several, count, order = seeds_of(batches)
        flags = np.frombuffer(b"".join(answers.sort_values("bucket")["flags"]), np.uint8)
        assert len(flags) == len(seed), "these answers belong to another part"
        shared, giant = np.zeros(len(order), bool), np.zeros(len(order), bool)
        shared[order] = np.repeat(several | (flags & 1 > 0), count)
        giant[order] = np.repeat(flags & 2 > 0, count)
        cuts = np.cumsum([len(b.runs.seed) for b in batches])[:-1]
        return cls(np.split(shared, cuts), np.split(giant, cuts))

    def runs(self, number: int, batch: Batch, unit: Unit) -> tuple[Runs, np.ndarray, list[bytes]]:
        """The runs of a batch with a shared seed, whether they are single windows of a giant one, and their texts."""
        shared, big = self.shared[number], self.giant[number]
        few, many = batch.runs.pick(shared & ~big), batch.runs.pick(shared & big)
        each = np.repeat(np.arange(len(many.seed)), many.size)
        step = np.arange(len(each)) - np.repeat(np.cumsum(many.size) - many.size, many.size)
        many = many.pick(each)
        all_runs = Runs(
            np.r_[few.doc, many.doc],
            np.r_[few.first, many.first + step],
            np.r_[few.size, np.ones(len(each), np.int64)],
            np.r_[few.seed, many.seed],
            np.r_[few.anchor, many.anchor],
        )
        low, high = batch.elements.bounds(all_runs.first, all_runs.first + all_runs.size + (unit.window - 2))
        buffer = batch.elements.buffer
        texts = [buffer[a:b] for a, b in zip(low, high, strict=True)]
        return all_runs, np.r_[np.zeros(len(few.seed), bool), np.ones(len(each), bool)], texts


@dataclass
class Entries:
    """The different run texts of a part, sorted by bucket, seed and text, each with its smallest document.

    ``runs`` are those of each batch that have a shared seed, and which entry each is.
    """

    bucket: np.ndarray
    text: list[bytes]
    seed: np.ndarray
    doc: np.ndarray
    runs: list[tuple[Runs, np.ndarray]] = field(repr=False)


def numbering() -> defaultdict:
    """Numbers for what is looked up, in the order of first sight."""
    return defaultdict(itertools.count().__next__)


def entries_of(batches: list[Batch], shared: Shared, unit: Unit, place: Callable[[bytes], int], buckets: int) -> Entries:
    """``place`` gives the bucket of the text of a run's seed; single windows go by a hash of theirs."""
    known = numbering()
    found: list[tuple[Runs, np.ndarray]] = []
    seeds, homes, leasts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(0, np.int64)
    places: dict[int, int] = {}
    for number, batch in enumerate(batches):
        runs, alone, texts = shared.runs(number, batch, unit)
        had = len(known)
        entry = np.fromiter(map(known.__getitem__, texts), np.int64, len(texts))
        found.append((runs, entry))
        leasts = np.append(leasts, np.full(len(known) - had, np.iinfo(np.int64).max))
        np.minimum.at(leasts, entry, batch.ids[runs.doc])
        at = np.zeros(len(known) - had, np.int64)
        new = np.flatnonzero(entry >= had)[::-1]
        at[entry[new] - had] = new
        low, high = batch.elements.bounds(runs.anchor[at], runs.anchor[at] + (unit.seed - 1))
        seed, home = runs.seed[at], np.zeros(len(at), np.int64)
        for i, (own, a, b, single) in enumerate(zip(seed.tolist(), low, high, alone[at].tolist(), strict=True)):
            if single:
                seed[i] = own = xxhash.xxh3_64_intdigest(texts[at[i]])
                home[i] = own % buckets
                continue
            bucket = places.get(own)
            if bucket is None:
                bucket = places[own] = place(batch.elements.buffer[a:b])
            home[i] = bucket
        seeds.append(seed)
        homes.append(home)
    text, seed, home = list(known), np.concatenate(seeds), np.concatenate(homes)
    order = np.argsort(seed)
    order = order[np.argsort(home[order], kind="stable")]
    same = (np.diff(seed[order]) == 0) & (np.diff(home[order]) == 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    for low, high in edges.reshape(-1, 2).tolist():
        order[low : high + 1] = sorted(order[low : high + 1].tolist(), key=text.__getitem__)
    where = np.zeros(len(order), np.int64)
    where[order] = np.arange(len(order))
    return Entries(
        home[order],
        [text[i] for i in order.tolist()],
        seed[order],
        leasts[order],
        [(runs, where[entry]) for runs, entry in found],
    )


def tell_runs(entries: Entries, part: int) -> pd.DataFrame:
    """Messages of a part to the run buckets."""
    rows = []
    for b in np.unique(entries.bucket):
        low, high = np.searchsorted(entries.bucket, [b, b + 1])
        texts = entries.text[low:high]
        rows.append(
            (
                int(b),
                part,
                np.array([len(t) for t in texts], "<u4").tobytes(),
                entries.seed[low:high].astype("<u8").tobytes(),
                entries.doc[low:high].astype("<i8").tobytes(),
                b"".join(texts),
            )
        )
    return pd.DataFrame(rows, columns=["bucket", "part", "sizes", "seeds", "docs", "texts"])


def compare_runs(messages: pd.DataFrame, window_minima: Callable) -> pd.DataFrame:
    """A run bucket's answers: for each run sent, a bit for each window that starts in a smaller document than its own.

    Runs are compared as text. A text whose seed has no other text decides all its
    windows at once; of seeds with several texts, ``window_minima`` compares the windows.
    """
    texts = numbering()
    index, docs, seeds, sizes = [], [], [], []
    for m in messages.itertuples(index=False):
        ends = np.cumsum(np.frombuffer(m.sizes, "<u4"), dtype=np.int64)
        bounds = zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)
        index.append(np.fromiter((texts[m.texts[a:b]] for a, b in bounds), np.int64, len(ends)))
        docs.append(np.frombuffer(m.docs, "<i8"))
        seeds.append(np.frombuffer(m.seeds, "<u8"))
        sizes.append(len(docs[-1]))
    number, doc = np.concatenate(index), np.concatenate(docs)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc)
    seed = np.zeros(len(texts), np.uint64)
    seed[number] = np.concatenate(seeds)
    _, of, kinds = np.unique(seed, return_inverse=True, return_counts=True)
    branching = np.flatnonzero(kinds[of] > 1)
    bits = np.zeros(len(texts), np.uint32)
    if len(branching):
        every = list(texts)
        bits[branching] = window_minima([every[i] for i in branching], least[branching])
    masks = np.where(least[number] < doc, _ALL, bits[number])
    cuts = np.split(masks.astype("<u4"), np.cumsum(sizes)[:-1])
    return pd.DataFrame(
        {"part": messages["part"].to_numpy(), "bucket": messages["bucket"].to_numpy(), "masks": [c.tobytes() for c in cuts]}
    )


def covered(batches: list[Batch], entries: Entries, answers: pd.DataFrame, unit: Unit) -> Iterator[tuple]:
    """``(row, elements, place, covered)`` of every row of a part.

    ``covered`` says which of the row's elements lie in a window that also starts in a smaller
    document; ``place`` is where they lie among the batch's ``elements``.
    """
    masks = np.frombuffer(b"".join(answers.sort_values("bucket")["masks"]), "<u4")
    assert len(masks) == len(entries.text), "these answers belong to another part"
    for batch, (runs, entry) in zip(batches, entries.runs, strict=True):
        every = ((np.uint64(1) << runs.size.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        mask = np.where(batch.ids[runs.doc] > entries.doc[entry], _ALL, masks[entry]) & every
        marks = np.zeros(int(batch.elements.lengths.sum()) + 1, np.int32)
        whole = mask == every
        np.add.at(marks, runs.first[whole], 1)
        np.add.at(marks, runs.first[whole] + runs.size[whole] + (unit.window - 1), -1)
        some = ~whole & (mask > 0)
        first, mask = runs.first[some], mask[some]
        for bit in range(unit.window - unit.seed + 1):
            at = first[(mask >> np.uint32(bit)) & np.uint32(1) > 0] + bit
            np.add.at(marks, at, 1)
            np.add.at(marks, at + unit.window, -1)
        removed = np.cumsum(marks[:-1], dtype=np.int32) > 0
        end = np.cumsum(batch.elements.lengths)
        for row, high, size in zip(batch.rows.tolist(), end.tolist(), batch.elements.lengths.tolist(), strict=True):
            yield row, batch.elements, slice(high - size, high), removed[high - size : high]


def untouched(frame: pd.DataFrame, unit: Unit) -> Iterator[tuple]:
    """What ``covered`` says of rows that lose nothing."""
    for batch in batches_of(frame, unit):
        end = np.cumsum(batch.elements.lengths)
        for row, high, size in zip(batch.rows.tolist(), end.tolist(), batch.elements.lengths.tolist(), strict=True):
            yield row, batch.elements, slice(high - size, high), np.zeros(size, bool)


def remove_repeats(
    docs: DataFrame,
    unit: Unit,
    place: Callable[[bytes], int] | None,
    window_minima: Callable,
    finish: Callable[[pd.DataFrame, Iterator[tuple]], pd.DataFrame],
    schema: str,
    part_bytes: int = PART_BYTES,
    giant: int = GIANT,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Runs the three steps. ``finish`` turns a part and what ``covered`` says of it into rows of ``schema``;
    it also sees the columns in ``carry``.

    All steps deal documents by the same exchange, which Spark runs once. Nothing is kept but
    shuffles, which Spark makes again for a lost executor.
    """
    if unit.window - unit.seed + 1 > 32:
        raise ValueError("a run's windows have to fit into 32 bits")
    parts = parts_for(text_bytes(docs.filter("doc_id is not null")), part_bytes)
    bits = (parts - 1).bit_length()
    buckets = parts
    at = place(buckets) if place else lambda seed: xxhash.xxh3_64_intdigest(seed) % buckets
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    name = "part"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    dealt = docs.filter("doc_id is not null").select("doc_id", "text", *carry, part.alias(name))

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        return tell_seeds(frame, int(frame[name].iloc[0]), unit, bits)

    def second(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        batches = batches_of(frame, unit)
        entries = entries_of(batches, Shared.of(batches, answers), unit, at, buckets)
        return tell_runs(entries, int(frame[name].iloc[0]))

    def third(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        batches = batches_of(frame, unit)
        entries = entries_of(batches, Shared.of(batches, answers[answers["flags"].notna()]), unit, at, buckets)
        return finish(frame, covered(batches, entries, answers[answers["masks"].notna()], unit))

    flags = (
        dealt.groupBy(name)
        .applyInPandas(first, "bucket int, part int, seeds binary, counts binary")
        .groupBy("bucket")
        .applyInPandas(lambda m: compare_seeds(m, giant), "part int, bucket int, flags binary")
    )
    masks = (
        dealt.groupBy(name)
        .cogroup(flags.groupBy("part"))
        .applyInPandas(second, "bucket int, part int, sizes binary, seeds binary, docs binary, texts binary")
        .groupBy("bucket")
        .applyInPandas(lambda m: compare_runs(m, window_minima), "part int, bucket int, masks binary")
    )
    answers = flags.withColumn("masks", F.lit(None).cast("binary")).unionByName(
        masks.withColumn("flags", F.lit(None).cast("binary"))
    )
    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield finish(frame, untouched(frame, unit))

    unknown = docs.filter("doc_id is null").select("doc_id", "text", *carry).mapInPandas(alone, schema)
    return dealt.groupBy(name).cogroup(answers.groupBy("part")).applyInPandas(third, schema).union(unknown)
