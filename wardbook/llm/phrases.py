"""Phrase collocations by prefix-free parsing: phrases are counted in distinct chunks of text, not in the text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardbook.llm.support import parts_for, summed, table, written

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
CONTAINED = 80
"""Per cent of a phrase's count that a longer phrase must have to stand for it."""
SCALE = 2_000_000
MODULUS = 8
"""One word window in so many begins a new chunk."""
SLICE = 1 << 23
"""Bytes of text or chunks that a task works on at once (a longer one alone)."""
BLOCK = 1 << 15
"""Bits of one row of a bit set, as Spark's bitmap aggregate makes them."""
BITS_EACH = 64
MAX_BITS = 1 << 28
"""Bits of a bit set at most, 32 MB, whatever the number of its members."""
HELD = 1 << 22
"""Pairs of words that a task counts before it sends them."""
SENT = 1 << 19
"""Distinct chunks, about, whose pairs go to one bucket."""
RANKED = 1 << 18
"""Phrases of one language that one task sorts."""
GOES_ON = "\n"
"""Ends a chunk that another chunk of its piece follows; words and pieces never hold it."""

_STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARK = GOES_ON.encode()
_CODES = np.random.default_rng(12).integers(0, 2**64, 256, np.uint64)
_TABLE = bytes.maketrans(_UPPER + _STOPS + b"\t", _UPPER.lower() + b"\n" * len(_STOPS) + b" ")


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[str, pa.Table]]:
    """The rows of a task in slices of bounded bytes, one language at a time."""

    def by_language(held: list[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
        rows = pa.Table.from_batches(held)
        for lang in rows["lang"].unique().to_pylist():
            yield lang, rows.filter(pc.equal(rows["lang"], lang))

    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(ends):
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + SLICE - size, "right")))
            held.append(batch.slice(begin, end - begin))
            size += int(ends[end - 1]) - done
            begin = end
            if size >= SLICE:
                yield from by_language(held)
                held, size = [], 0
    if held:
        yield from by_language(held)


class Words(NamedTuple):
    """The words of some bytes in order, as Arrow numbers them."""

    starts: np.ndarray
    sizes: np.ndarray
    numbers: np.ndarray
    """A number of each word, equal for equal words."""
    known: pa.Array
    """The words by number."""


def words_in(data: np.ndarray, begins: np.ndarray) -> Words:
    """The words between spaces and line feeds; none goes on over a place of ``begins``."""
    inside = (data != ord(" ")) & (data != ord("\n"))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[begins] = inside[begins]
    before = begins[begins > 0] - 1
    last[before] = inside[before]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    bounds = np.append(0, np.cumsum(sizes))
    letters = [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), letters).dictionary_encode()
    return Words(starts, sizes, coded.indices.to_numpy().astype(np.int64), coded.dictionary)


def hashes_of(words: pa.Array, seed: int) -> np.ndarray:
    """A hash of each word, as a polynomial in codes of its bytes. Different words may have one, which decides nothing."""
    if not len(words):
        return np.zeros(0, np.uint64)
    bounds = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[: bounds[-1]]
    sizes = np.diff(bounds)
    power = np.multiply.accumulate(np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(data)) - np.repeat(bounds[:-1], sizes)
    sums = np.add.reduceat(_CODES[data] * power[place], bounds[:-1]) ^ np.uint64(seed)
    sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return sums ^ (sums >> np.uint64(32))


def chunks_of(text: bytes, overlap: int, modulus: int) -> Counter:
    """The chunks of all pieces of ``text`` and how often each occurs.

    A window of ``overlap`` words whose hash is 0 by ``modulus`` ends a chunk and
    begins the next, which shares that window. Equal text around a window
    gives equal chunks, wherever it stands. A chunk that goes on ends with ``GOES_ON``.
    """
    data = np.frombuffer(text.translate(_TABLE), np.uint8)
    w = words_in(data, np.zeros(0, np.int64))
    count = len(w.starts)
    if not count:
        return Counter()
    begin = np.zeros(count + 1, bool)
    begin[np.searchsorted(w.starts, np.flatnonzero(data == ord("\n")))] = True
    begin[0] = True
    begins = np.flatnonzero(begin[:count])
    ends = np.append(begins[1:], count)
    hashes = hashes_of(w.known, 0)[w.numbers]
    window = np.zeros(count, np.uint64)
    room = max(count - overlap + 1, 0)
    for k in range(overlap):
        window[:room] = (window[:room] * np.uint64(0x9E3779B97F4A7C15) + hashes[k : room + k]) ^ (window[:room] >> np.uint64(29))
    within = np.arange(count) + overlap <= np.repeat(ends, ends - begins)
    begin = within & ((window >> np.uint64(7)) % np.uint64(modulus) == 0)
    begin[begins] = True
    starts = np.flatnonzero(begin)
    following = np.append(starts[1:], count)
    last = np.zeros(count + 1, bool)
    last[ends] = True
    last = last[following]
    stops = np.where(last, following, following + overlap)
    # The words with one separator after each: a chunk is a slice of that.
    inside = (data != ord(" ")) & (data != ord("\n"))
    inside[1:] |= inside[:-1]
    joined = data[inside].tobytes()
    after = np.cumsum(w.sizes + 1)
    low, high = (after - w.sizes - 1)[starts], after[stops - 1] - 1
    return Counter(
        joined[s:e] if final else joined[s:e] + _MARK
        for s, e, final in zip(low.tolist(), high.tolist(), last.tolist(), strict=True)
    )


def parse(batches: Iterator[pa.RecordBatch], overlap: int, modulus: int) -> Iterator[pa.RecordBatch]:
    for lang, rows in slices(batches, "text"):
        found = chunks_of(b"\n".join(rows["text"].cast(pa.binary()).to_pylist()), overlap, modulus)
        chunks = pa.array(list(found), pa.binary()).cast(pa.string())
        times = pa.array(list(found.values()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(found)), chunks, times], ["lang", "chunk", "times"])


class Chunks(NamedTuple):
    """Distinct chunks of one language, word by word."""

    data: bytes
    """All chunks; the words of a chunk have one space between them."""
    words: Words
    hashes: np.ndarray
    """The hash of each word."""
    left: np.ndarray
    """Words from here to the end of the chunk."""
    counted: np.ndarray
    """Whether phrases that begin here count here, and not in the chunk that follows."""
    times: np.ndarray


def read_chunks(lang: str, rows: pa.Table, overlap: int) -> Chunks:
    chunks = pa.concat_arrays(rows["chunk"].cast(pa.large_string()).chunks)
    bounds = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    words = words_in(data, bounds[:-1])
    sizes = np.diff(np.searchsorted(words.starts, bounds))
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    hashes = hashes_of(words.known, seed)[words.numbers]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words.starts))
    counted = left > np.repeat((data[bounds[1:] - 1] == ord("\n")) * overlap, sizes)
    times = np.repeat(rows["times"].to_numpy(), sizes)
    return Chunks(data.tobytes(), words, hashes, left, counted, times)


def members(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a bit set; those that are always may."""
    place = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash of each word and the one after it (of the last word, nothing that is used)."""
    after = np.append(hashes[1:], np.uint64(0))
    mixed = (hashes * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x9E3779B97F4A7C15) + (hashes >> np.uint64(31)))
    return mixed ^ (mixed >> np.uint64(29))


def count_pairs(
    batches: Iterator[pa.RecordBatch], overlap: int, bits: int, min_count: int
) -> Iterator[pa.RecordBatch]:
    """Messages to buckets: pairs of neighbouring words, as four bytes of a hash, and their counts up to ``min_count``.

    The first ``bits`` bits of the hash name the bucket.
    """

    def messages(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
        bounds = np.arange(1, 1 << bits).astype(np.uint64) << np.uint64(64 - bits) if bits else []
        cuts = np.searchsorted(keys, bounds)
        low, high = np.append(0, cuts).astype(np.int64), np.append(cuts, len(keys)).astype(np.int64)
        buckets = np.flatnonzero(low < high)
        short, counts = keys.astype("<u4"), np.minimum(counts, min_count).astype(np.min_scalar_type(min_count))
        places = list(zip(low[buckets].tolist(), high[buckets].tolist(), strict=True))
        columns = [pa.array(buckets, pa.int32())] + [
            pa.array([values[s:e].tobytes() for s, e in places], pa.binary()) for values in (short, counts)
        ]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "hashes", "counts"])

    held, size = [], 0
    for lang, rows in slices(batches, "chunk"):
        c = read_chunks(lang, rows, overlap)
        at = np.flatnonzero(c.counted & (c.left >= 2))
        held.append(summed(pair_hashes(c.hashes)[at], c.times[at]))
        size += len(held[-1][0])
        if size >= HELD:
            yield messages(held)
            held, size = [], 0
    if held:
        yield messages(held)


def frequent_pairs(messages: pa.Table, min_count: int) -> pa.Table:
    """Of one bucket's hashes, those that occur ``min_count`` times."""
    hashes = np.frombuffer(b"".join(messages["hashes"].to_pylist()), "<u4")
    counts = np.frombuffer(b"".join(messages["counts"].to_pylist()), np.min_scalar_type(min_count))
    keys, counts = summed(hashes, counts.astype(np.int64))
    return pa.table({"hash": keys[counts >= min_count].astype(np.int64)})


def count_phrases(
    batches: Iterator[pa.RecordBatch], overlap: int, max_words: int, pairs
) -> Iterator[pa.RecordBatch]:
    """Counts of words, of all words as that of the phrase null, and of phrases whose pairs of neighbouring words
    may all be frequent, by their text."""
    names = ["lang", "phrase", "f"]
    for lang, rows in slices(batches, "chunk"):
        c = read_chunks(lang, rows, overlap)
        counts = np.zeros(len(c.words.known), np.int64)
        np.add.at(counts, c.words.numbers[c.counted], c.times[c.counted])
        met = np.flatnonzero(counts)
        words = c.words.known.take(pa.array(met)).cast(pa.binary()).cast(pa.string())
        words = pa.concat_arrays([pa.nulls(1, pa.string()), words])
        counts = np.append(counts.sum(), counts[met])
        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(words)), words, pa.array(counts)], names)
        good = (c.left >= 2) & members(pairs.value, pair_hashes(c.hashes))
        at, ids = np.flatnonzero(good), c.words.numbers
        starts, ends = c.words.starts, c.words.starts + c.words.sizes
        for n in range(2, max_words + 1):
            # Phrases of n words are those of n - 1 whose last two words are a good pair; each gets a number.
            if n > 2:
                at = at[(c.left[at] >= n) & good[np.minimum(at + n - 2, len(good) - 1)]]
            if not len(at):
                break
            first, place = np.unique(ids[at] * len(c.words.known) + c.words.numbers[at + n - 1], return_inverse=True)
            ids = np.zeros(len(starts), np.int64)
            ids[at] = place
            here = c.counted[at]
            keys, counts = summed(place[here], c.times[at][here])
            shown = np.zeros(len(first), np.int64)
            shown[place] = at
            shown = shown[keys]
            low, high = starts[shown].tolist(), ends[shown + n - 1].tolist()
            phrases = pa.array([c.data[s:e] for s, e in zip(low, high, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(keys)), phrases, pa.array(counts)], names)


def bit_set(hashes: DataFrame):
    """Hashes (a written table) as a broadcast set of bits, ``BITS_EACH`` for each up to ``MAX_BITS``.

    Other hashes may seem to be in it, the more the fuller it is: it saves work and
    decides nothing. Spark makes its rows of 4 KB; only these, 32 MB at most, come to the driver.
    """
    bits = BLOCK
    while bits < min(MAX_BITS, BITS_EACH * hashes.count()):
        bits *= 2
    place = F.expr(f"hash & {bits - 1}L")
    rows = (
        hashes.select(place.alias("place"))
        .groupBy(F.expr(f"place div {BLOCK}").alias("block"))
        .agg(F.bitmap_construct_agg(F.expr(f"place % {BLOCK}")).alias("bits"))
    )
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.toLocalIterator():
        begin = row["block"] * BLOCK // 8
        out[begin : begin + BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def dictionary(docs: DataFrame, overlap: int, modulus: int) -> DataFrame:
    """``lang, chunk, times``: the distinct chunks of all texts and how often each is met in the parse."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = rows.mapInArrow(partial(parse, overlap=overlap, modulus=modulus), "lang string, chunk string, times long")
    return chunks.groupBy("lang", "chunk").agg(F.sum("times").alias("times"))


def frequencies(docs: DataFrame, max_words: int, min_count: int, modulus: int = MODULUS) -> tuple[DataFrame, DataFrame]:
    """``(lang, n)`` and ``(lang, phrase, f)`` of all phrases of up to ``max_words`` words that occur ``min_count`` times."""
    overlap = max_words - 1
    chunks = written(dictionary(docs, overlap, modulus))
    spread = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = (max(parts_for(chunks.count(), SENT), spread) - 1).bit_length()
    pairs = chunks.mapInArrow(
        partial(count_pairs, overlap=overlap, bits=bits, min_count=min_count), "bucket int, hashes binary, counts binary"
    )

    def frequent(messages: pa.Table) -> pa.Table:
        return frequent_pairs(messages, min_count)

    pairs = bit_set(written(pairs.groupBy("bucket").applyInArrow(frequent, "hash long")))
    phrases = chunks.mapInArrow(
        partial(count_phrases, overlap=overlap, max_words=max_words, pairs=pairs), "lang string, phrase string, f long"
    )
    counted = phrases.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    counted = written(counted.filter((F.col("f") >= min_count) | F.col("phrase").isNull()))
    totals = counted.filter("phrase is null").select("lang", F.col("f").alias("n"))
    return totals, counted.filter("phrase is not null")


def scored(found: DataFrame, max_words: int, scale: int) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of all phrases of two words or more, by their lowest-scoring cut."""
    split = found.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words"))
    phrases = split.filter("size > 1").withColumnRenamed("f", "a")
    cuts = phrases.select(
        "lang", "phrase", "size", "a", "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k")
    ).select(
        "lang",
        "phrase",
        "size",
        "a",
        "k",
        F.expr("array_join(slice(words, 1, k), ' ')").alias("left_part"),
        F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("right_part"),
    )
    left = found.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l"))
    right = found.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r"))
    score = F.expr(f"cast(a as decimal(20,0)) * {scale}BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    return (
        cuts.join(left, ["lang", "left_part"])
        .join(right, ["lang", "right_part"])
        .groupBy("lang", "phrase", "size", "a")
        .agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")
    )


def uncovered(phrases: DataFrame, contained: int) -> DataFrame:
    """Phrases without those whose words lie in a longer one that has ``contained`` per cent of their count."""
    words = F.split("phrase", " ")
    inside = (
        phrases.filter("size > 2")
        .select("lang", "a", "size", words.alias("words"))
        .select("lang", "a", "size", "words", F.explode(F.expr("sequence(2, size - 1)")).alias("n"))
        .select("lang", "a", "words", "n", F.explode(F.expr("sequence(1, size - n + 1)")).alias("i"))
        .select("lang", F.expr("array_join(slice(words, i, n), ' ')").alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("around"))
    )
    covered = F.expr(f"100BD * around >= {contained}BD * a")
    return phrases.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("around")


def first_of(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language and their ranks.

    Parts of a language's phrases keep their own first ``top``, and only these are ranked together.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = parts_for(phrases.count(), RANKED)
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    some = phrases.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(order))
    )
    ranked = some.filter(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(order)).cast("long")
    )
    return ranked.filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    contained: int = CONTAINED,
    scale: int = SCALE,
    modulus: int = MODULUS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` collocations of each language.

    Texts are lower-cased (A-Z) and cut into pieces at stops and line ends, pieces into
    words at spaces and tabs. A null text is empty and a null language is ``und``.
    Rows count as often as they occur, whatever their ``doc_id``; other columns are
    not read. Languages without a frequent phrase, and empty tables, give no row.

    A parse cuts pieces into overlapping chunks where word windows say so
    (``chunks_of``); the distinct chunks and how often each occurs are all that is
    counted. A phrase lies whole in a chunk and counts where it begins
    outside the overlap with the next, so once. Pairs of words are counted first, by hash; a bit set of
    bounded size then keeps out phrases that hold an infrequent pair, and words and the other phrases are
    counted by their text. All counts that decide are exact.
    """
    totals, found = frequencies(docs, max_words, min_count, modulus)
    phrases = written(scored(found, max_words, scale))
    best = first_of(written(uncovered(phrases, contained)), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _phrases_of(relation: str) -> str:
    """SQL for every phrase of up to ``MAX_WORDS`` words in a relation of word lists."""
    sizes = [
        f"select lang, {n} as size, array_to_string(words[i : i + {n - 1}], ' ') as phrase from "
        f"(select lang, words, unnest(range(1, len(words) - {n - 2})) as i from {relation} where len(words) >= {n})"
        for n in range(1, MAX_WORDS + 1)
    ]
    return " union all ".join(sizes)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(string_split_regex(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'),
                                     '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents
),
spoken as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as words from pieces),
found as (
    select lang, size, phrase, count(*) as f from ({_phrases_of("spoken")})
    group by all having count(*) >= {MIN_COUNT}
),
cuts as (
    select lang, phrase, size, f as a, string_split(phrase, ' ') as words, unnest(range(1, size)) as k
    from found where size > 1
),
cut_scores as (
    select c.lang, c.phrase, c.size, c.a, c.k, l.f as l, r.f as r,
           (({SCALE}::hugeint * c.a) // (l.f + r.f))::bigint as score
    from cuts c
    join found l on l.lang = c.lang and l.phrase = array_to_string(c.words[1 : c.k], ' ')
    join found r on r.lang = c.lang and r.phrase = array_to_string(c.words[c.k + 1 : c.size], ' ')
),
scores as (
    select * from cut_scores qualify row_number() over (partition by lang, phrase order by score, k) = 1
),
inside as (
    select lang, array_to_string(words[i : i + n - 1], ' ') as phrase, max(a) as around
    from (select lang, a, words, n, unnest(range(1, size - n + 2)) as i
          from (select lang, a, size, string_split(phrase, ' ') as words, unnest(range(2, size)) as n
                from scores where size > 2))
    group by all
),
kept as (
    select s.* from scores s left join inside i on i.lang = s.lang and i.phrase = s.phrase
    where i.around is null or 100::hugeint * i.around < {CONTAINED}::hugeint * s.a
),
ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
),
totals as (select lang, sum(len(words))::bigint as n from spoken group by lang)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
from ranked r join totals t on t.lang = r.lang
where r.rank <= {TOP}
"""
