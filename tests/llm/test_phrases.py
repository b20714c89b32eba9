from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import DOCUMENT, ODD_ROWS
from wardbook.llm import phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def pieces(text):
    cut = re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))
    return [re.findall("[^\x20\x09]+", p) for p in cut]


def counts_of(texts, max_words):
    found = Counter()
    for text in texts:
        for words in pieces(text):
            found.update(
                tuple(words[i : i + n]) for n in range(1, max_words + 1) for i in range(len(words) - n + 1)
            )
    return found


def collocated_plainly(rows, max_words, min_count, top, contained):
    """Rows of the query by the contract's words, from ``(lang, text)``."""
    out = []
    rows = [("und" if lang is None else lang, t) for lang, t in rows]
    for lang in {lang for lang, _ in rows}:
        found = counts_of([t for own, t in rows if own == lang], max_words)
        n = sum(c for p, c in found.items() if len(p) == 1)
        often = {p: c for p, c in found.items() if len(p) > 1 and c >= min_count}
        scored = []
        for phrase, a in often.items():
            longer = [c for p, c in often.items() if len(p) > len(phrase) and any(
                p[i : i + len(phrase)] == phrase for i in range(len(p) - len(phrase) + 1)
            )]
            if any(100 * c >= contained * a for c in longer):
                continue
            cuts = [(found[phrase[:k]], found[phrase[k:]], k) for k in range(1, len(phrase))]
            score, _, left, right = min((2000000 * a // (s + t), k, s, t) for s, t, k in cuts)
            scored.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def table_of(spark, rows):
    full = [(i, t, lang, "s", 0, "x", 1) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCUMENT + ", phrase string, n int")


@pytest.mark.parametrize(
    "options",
    [
        {"max_words": 4, "min_count": 2, "top": 50, "contained": 80},
        {"max_words": 3, "min_count": 3, "top": 7, "contained": 100},
        {"max_words": 2, "min_count": 1, "top": 1000, "contained": 80},
    ],
)
@pytest.mark.parametrize("modulus", [1, 3])
def test_collocations_against_plain_counts(spark, documents, options, modulus):
    rows = [(None if i == 3 else "en", t) for i, (_, t) in enumerate(ODD_ROWS) if t is None or len(t) < 2000]
    rows += [("en", "The the THE the. the the, of the; É é É é a\tb  a b\r\na b"), ("", "x y x y"), ("en", "the the the"), ("fr", None)]
    rows += [(r["lang"], r["text"][:500]) for r in documents.orderBy("doc_id").limit(8).collect()]
    found = phrases.collocations(table_of(spark, rows), modulus=modulus, **options).collect()
    assert sorted(tuple(r) for r in found) == collocated_plainly(rows, **options)


def test_collocations_of_empty_tables(spark):
    assert phrases.collocations(table_of(spark, [])).count() == 0
    assert phrases.collocations(table_of(spark, [("en", None), (None, "")])).count() == 0


def test_long_runs_count_exactly(spark):
    rows = [("en", "a " * 50000 + "b"), ("en", "a a a a")]
    found = {r["phrase"]: r for r in phrases.collocations(table_of(spark, rows)).collect()}
    assert {p: r["a"] for p, r in found.items()} == {"a a a a": 49998}
    assert found["a a a a"]["n"] == 50005


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab cC\t.\n"), max_size=80), st.integers(1, 4), st.sampled_from([1, 2, 3, 50]))
def test_chunks_hold_each_phrase_once(text, overlap, modulus):
    found = Counter()
    for chunk, times in phrases.chunks_of(text.encode(), overlap, modulus).items():
        words = chunk.decode().split()
        starts = len(words) - (overlap if chunk.endswith(b"\n") else 0)
        for i in range(starts):
            for n in range(1, overlap + 2):
                if i + n <= len(words):
                    found[tuple(words[i : i + n])] += times
    assert found == counts_of([text], overlap + 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé \n"), min_size=1, max_size=12), max_size=8))
def test_words_in_bytes(parts):
    parts = [p.encode() for p in parts]
    begins = np.cumsum([0, *map(len, parts)])[:-1]
    data = b"".join(parts)
    found = phrases.words_in(np.frombuffer(data, np.uint8), begins)
    expected = [w for p in parts for w in p.split()]
    assert [data[s : s + n] for s, n in zip(found.starts.tolist(), found.sizes.tolist(), strict=True)] == expected
    assert [found.known[i].as_py() for i in found.numbers.tolist()] == expected
    hashes = phrases.hashes_of(found.known, 7)
    assert len(set(hashes.tolist())) == len(set(expected))


def test_pairs_travel_packed():
    """A task sends a pair once, in one message to a bucket, and counts too large for a byte still count."""
    chunks = [pa.RecordBatch.from_pydict({"lang": ["en"], "chunk": [c], "times": pa.array([t], pa.int64())})
              for c, t in [("a b c", 1000), ("b c d", 29), ("d a b\n", 1), ("x y", 20)]]
    sent = [list(phrases.count_pairs(iter(part), 1, 2, 30)) for part in (chunks[:2], chunks[2:])]
    for batches in sent:
        assert len(batches) == 1
        assert batches[0]["bucket"].to_pylist() == sorted(set(batches[0]["bucket"].to_pylist()))
    table = pa.Table.from_batches([b for batches in sent for b in batches])
    assert sum(len(h) for h in table["hashes"].to_pylist()) == 4 * (3 + 3)
    frequent = []
    for bucket in set(table["bucket"].to_pylist()):
        rows = table.filter(pc.equal(table["bucket"], bucket))
        frequent += phrases.frequent_pairs(rows, 30)["hash"].to_pylist()
    assert len(frequent) == 2


def test_frequencies_of_many_pairs(spark):
    rows = [("en", " ".join(f"w{i * j % 997}" for j in range(400)) + ".") for i in range(1, 60)]
    totals, found = phrases.frequencies(table_of(spark, rows), 2, 30)
    assert totals.collect() == [("en", 59 * 400)]
    plain = {" ".join(p): c for p, c in counts_of([t for _, t in rows], 2).items() if c >= 30}
    assert {r["phrase"]: r["f"] for r in found.collect()} == plain
