"""Cross-tokenizer alignment: spans of two tokenizers give coarse cuts, decoded bytes refine them, pairs are counted by Spark."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from wardbook.llm.support import table, written
from wardbook.llm.tokens import byte_letters, once

VOCABULARY_A = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY_B = public_tokenizers.path("piece_bpe_32k.model")
BROADCAST_PAIRS = 1 << 21
"""Pairs of ids are broadcast with their counts up to this many (some 64 MB), and joined by a shuffle beyond."""
SHIFT = 20
"""An id pair is one number: the first id above these bits, the second below. Vocabularies have at most a million ids."""
SLICE = 1 << 22
"""Characters of text that a task aligns at once (a longer text alone)."""
KNOWN = 1 << 19
"""Words that a task remembers the alignment of; then it starts anew."""
LINE = 1 << 6
"""New words that go through the tokenizers as one line."""
CALL = 1 << 19
"""Characters of such lines that are aligned at once."""
SAFE = re.compile(r"(?<=\S) (?=\S)")
"""A single space between two other characters: both tokenizers begin a token there, whatever stands around it."""


def apart(words: list[str]) -> bool:
    """Whether the spaces between these words are all safe, and their ends no spaces."""
    return "" not in words and list(map(str.strip, words)) == words


class Aligned(NamedTuple):
    """Groups and links of consecutive words: numbers per word, and links and group texts laid end to end."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    groups: list[str]


class Tokenizers:
    """Both tokenizers, the bytes of each of their tokens, and the id texts that group digests are made of."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        added = self.a.get_added_tokens_decoder()
        size_a = max([*self.a.get_vocab(with_added_tokens=True).values(), *added]) + 1
        self.bytes_a = [b""] * size_a
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = token.encode() if i in added else bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        if max(size_a, len(pieces)) > 1 << SHIFT:
            raise ValueError(f"vocabularies of more than {1 << SHIFT} ids are not supported")
        self.width_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.width_b = np.array([len(b) for b in self.bytes_b], np.int64)
        # Each id as text with what may follow it in a digest: "," within a side, "|" after the first, ";" after the second.
        self.text = np.array([f"{i}{end}" for end in ",|;" for i in range(max(size_a, len(pieces)))], object)
        self.stride = max(size_a, len(pieces))
        self.text_width = np.array([len(t) for t in self.text], np.int64)
        by_words = '"use_regex":true' in self.a.to_str().replace(" ", "") and "ByteLevel" in self.a.to_str()
        self.divisible = by_words and not any("▁" in p.lstrip("▁") for p in pieces)

    def words(self, text: str) -> list[str]:
        """``text`` cut at safe spaces, where these vocabularies have such places; each word stands for a space and itself."""
        if not self.divisible:
            return [text]
        plain = text.split(" ")
        return plain if apart(plain) else SAFE.split(text)


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return once(("alignment", path_a, path_b), lambda: Tokenizers(path_a, path_b))


def refined(begin: np.ndarray, end: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from their coarse byte spans and the numbers of bytes they decode to.

    A span that ends where the next begins cuts the text there. Tokens without a
    cut of their own, parts of one character or byte-fallback tokens, share
    the bytes since the cut before them as their decoded bytes say.
    """
    clean = end > begin
    clean[:-1] &= end[:-1] <= begin[1:]
    total = np.cumsum(width)
    shift = np.where(clean, end - total, 0)
    before = np.maximum.accumulate(np.where(clean, np.arange(len(clean)), -1))
    before = np.concatenate([[-1], before[:-1]])[: len(clean)]
    return np.where(clean, end, total + np.where(before >= 0, shift[before], 0))


def token_ends(lines: list[str], both: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids and byte ends of both tokenizers over lines with a space before each; None where the tokens' bytes are not theirs.

    Lines are encoded one by one, as both libraries are fastest on short texts, and laid end to end.
    """
    full = [" " + line for line in lines]
    data = [f.encode() for f in full]
    encoded = [both.a.encode(f, add_special_tokens=False) for f in full]
    pieces = [both.b.encode(line, return_type="proto").pieces for line in lines]
    of_a, of_b = [i for e in encoded for i in e.ids], [p.id for line in pieces for p in line]
    whole = b"".join(data)
    if any(b"".join(map(known.__getitem__, ids)) != whole for ids, known in ((of_a, both.bytes_a), (of_b, both.bytes_b))):
        return None
    ids_a, ids_b = np.array(of_a, np.int64), np.array(of_b, np.int64)
    spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in encoded)), np.int64, 2 * len(of_a))
    starts = np.cumsum([0, *map(len, full)])[:-1]
    spans = spans.reshape(-1, 2) + np.repeat(starts, [len(e) for e in encoded])[:, None]
    if len(whole) != sum(map(len, full)):
        points = np.frombuffer("".join(full).encode("utf-32-le"), "<u4")
        wide = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        spans = np.concatenate([[0], np.cumsum(wide)])[spans]
    ends_a = refined(spans[:, 0], spans[:, 1], both.width_a[ids_a])
    # Spans of pieces are in bytes and follow each other without a gap, so each begins where the one before ends.
    starts = np.repeat(np.cumsum([0, *map(len, data)])[:-1] + 1, [len(line) for line in pieces])
    end = np.array([p.end for line in pieces for p in line], np.int64) + starts
    ends_b = refined(np.concatenate([[0], end[:-1]]), end, both.width_b[ids_b])
    return ids_a, ends_a, ids_b, ends_b


def align(lines: list[list[str]], both: Tokenizers) -> Aligned | None:
    """Groups and links of lines of words, each word standing for a space and itself; None where bytes differ."""
    found = token_ends([" ".join(line) for line in lines], both)
    if found is None:
        return None
    ids_a, ends_a, ids_b, ends_b = found
    begin_a, begin_b = (np.concatenate([[0], e[:-1]]) for e in (ends_a, ends_b))
    first, behind = np.searchsorted(ends_b, begin_a, "right"), np.searchsorted(begin_b, ends_a, "left")
    last_a = ends_b[behind - 1] == ends_a
    cuts = ends_a[last_a]
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    last_b = cuts[group_b] == ends_b
    links = behind - first
    at = np.arange(links.sum()) + np.repeat(first - (np.cumsum(links) - links), links)
    pairs = np.repeat(ids_a, links) << SHIFT | ids_b[at]

    order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
    texts = np.concatenate([ids_a + last_a * both.stride, ids_b + last_b * 2 * both.stride])[order]
    joined = "".join(both.text[texts])
    width = np.concatenate([[0], np.cumsum(both.text_width[texts])])

    ends = np.cumsum([len(w.encode()) + 1 for line in lines for w in line])
    to_a, to_b, to_group = (np.searchsorted(e, ends, "right") for e in (ends_a, ends_b, cuts))
    n_a, n_b, n_groups = (np.diff(t, prepend=0) for t in (to_a, to_b, to_group))
    n_links = np.diff(np.concatenate([[0], np.cumsum(links)])[to_a], prepend=0)
    places = width[np.concatenate([[0], to_a + to_b])].tolist()
    groups = [joined[s:e] for s, e in pairwise(places)]
    return Aligned(n_a, n_b, n_groups, n_links, pairs, groups)


class Memory:
    """Alignments of words by number, as arrays that rows of words are looked up in."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.counts = np.zeros((4, 0), np.int64)
        self.pairs, self.begin, self.groups = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        self.odd: set[str] = set()

    def learn(self, words: list[str]) -> None:
        """Align words not met before: many in a line where a space on each side leaves them as they are."""
        new = [w for w in words if w not in self.number and w not in self.odd]
        lines = [new[i : i + LINE] for i in range(0, len(new), LINE)]
        lines = [[line] if self.both.divisible and apart(line) else [[w] for w in line] for line in lines]
        lines = list(chain.from_iterable(lines))
        behind = np.cumsum([sum(map(len, line)) for line in lines])
        begin = 0
        while begin < len(lines):
            done = behind[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(behind, done + CALL)))
            self.add(lines[begin:end])
            begin = end

    def add(self, lines: list[list[str]]) -> None:
        """Remember the words of these lines; where bytes differ, line by line and then word by word."""
        found = align(lines, self.both)
        if found is None:
            smaller = [[line] for line in lines] if len(lines) > 1 else [[[word]] for word in lines[0]]
            if len(smaller) == 1:
                self.odd.update(lines[0])
                return
            for some in smaller:
                self.add(some)
            return
        for line in lines:
            for word in line:
                self.number[word] = len(self.number)
        counts = np.stack(found[:4])
        self.begin = np.concatenate([self.begin, len(self.pairs) + np.cumsum(counts[3]) - counts[3]])
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.pairs = np.concatenate([self.pairs, found.pairs])
        self.groups += found.groups


def counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its times."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(times, at) if len(at) else times


def align_slice(texts: list[str | None], memory: Memory) -> list:
    """Columns of a slice of texts: four counts, digests, and each text's distinct pairs with their times."""
    rows = [memory.both.words(t) if t else [] for t in texts]
    if len(memory.number) + len(memory.odd) > KNOWN:
        memory.clear()
    memory.learn(list(dict.fromkeys(chain.from_iterable(rows))))
    if memory.odd:
        for i, words in enumerate(rows):
            if not memory.odd.isdisjoint(words):
                # Bytes differ in some word, so the text as a whole decides.
                memory.learn([texts[i]])
                rows[i] = [] if texts[i] in memory.odd else [texts[i]]
    sizes = np.array([len(r) for r in rows], np.int64)
    numbers = np.array([memory.number[w] for w in chain.from_iterable(rows)], np.int64)
    places = np.concatenate([[0], np.cumsum(sizes)])
    counts = [np.diff(np.concatenate([[0], np.cumsum(c[numbers])])[places]) for c in memory.counts]
    groups = memory.groups
    digests = [
        hashlib.sha256("".join([groups[n] for n in some.tolist()])[:-1].encode()).hexdigest() if len(some) else ""
        for some in np.split(numbers, places[1:-1])
    ]
    # Each text's words once with their times, then the links of these, then each text's pairs once.
    keys, times = counted(np.repeat(np.arange(len(rows)), sizes) << SHIFT | numbers, np.ones(len(numbers), np.int64))
    row, number = keys >> SHIFT, keys & (1 << SHIFT) - 1
    links = memory.counts[3][number]
    spread = np.arange(links.sum()) + np.repeat(memory.begin[number] - (np.cumsum(links) - links), links)
    keys, times = counted(np.repeat(row, links) << 2 * SHIFT | memory.pairs[spread], np.repeat(times, links))
    ends = pa.array(np.searchsorted(keys >> 2 * SHIFT, np.arange(len(rows) + 1)), pa.int32())
    pairs = pa.ListArray.from_arrays(ends, keys & (1 << 2 * SHIFT) - 1)
    return [*counts, pa.array(digests, pa.string()), pairs, pa.ListArray.from_arrays(ends, times)]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<long>"
)


def align_batches(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    memory = Memory(tokenizers(path_a, path_b))
    for batch in batches:
        texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end] or "") <= SLICE):
                size += len(texts[end] or "")
                end += 1
            columns = align_slice(texts[begin:end], memory)
            arrays = [ids.slice(begin, end - begin), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, NAMES)
            begin = end


def aligned(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """Per text its counts, digest and distinct id pairs: one row for each row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        partial(align_batches, path_a=path_a, path_b=path_b), ALIGNED
    )


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, count, best``: in how many texts two ids are linked, and whether that is the first id's highest count."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = written(counts)
    highest = counts.groupBy(F.shiftright("pair", SHIFT).alias("id")).agg(F.max("count").alias("highest"))
    return counts.join(highest, F.shiftright(counts["pair"], SHIFT) == highest["id"]).select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")
    )


def alignment(
    docs: DataFrame,
    path_a: str = VOCABULARY_A,
    path_b: str = VOCABULARY_B,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    A is a byte-level file of ``tokenizers`` over a space and the text, B a
    ``sentencepiece`` model over the text, whose dummy prefix is that space. Null
    and empty texts, and texts that the tokens of A or B do not spell byte for byte,
    have no tokens: zeros and an empty digest. Rows that repeat a ``doc_id`` or have
    none get a row each and count as texts of their own. Other columns are not
    read. An empty table gives an empty one.

    A task cuts texts at single spaces, where both tokenizers always begin a token,
    and aligns each distinct word once, many in one call; what comes of a word does
    not depend on its neighbours. Spans give byte cuts and decoded bytes refine
    them (``refined``). Each text leaves its distinct pairs as a row of a table;
    Spark counts them over all texts and joins the counts back. The list of
    pairs is counted first: up to ``broadcast_pairs`` it goes to the tasks, which sum each
    text where it lies; a longer one is joined by a shuffle.
    """
    rows = written(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    counts = written(pair_counts(rows))
    side = F.broadcast(counts) if counts.count() <= broadcast_pairs else counts.hint("merge")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")
    )
    sums = (
        links.join(side, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
