from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.conftest import LONG, ODD_ROWS, in_order
from wardbook.llm import exact, simhash
from wardbook.llm.components import components


def sql_groups(documents):
    docs = documents.select("doc_id", "text").toPandas()  # noqa: F841  read by the statement
    return duckdb.sql(exact.SQL.replace("from documents", "from docs")).df().sort_values("doc_id").reset_index(drop=True)


@pytest.mark.parametrize("options", [{}, {"bucket_keys": 5}, {"hash_bits": 3}, {"hash_bits": 4, "bucket_keys": 1}])
def test_exact_groups_equal_sql(documents, options):
    found = in_order(exact.exact_duplicates(documents, **options), "doc_id")
    pd.testing.assert_frame_equal(found, sql_groups(documents)[list(found.columns)], check_dtype=False)


def test_directory_splits_only_overfull_buckets(spark):
    cells = spark.createDataFrame([(c, 10 if c < 4 else 1) for c in range(0, 65536, 1024)] + [(1, 10), (2, 10)], "cell int, keys int")
    pages = exact.directory(cells, 15).toPandas()
    load = pages.merge(cells.toPandas(), on="cell").groupby(["bucket", "depth"])["keys"].agg(["sum", "size"])
    assert (load["sum"] <= 15).all()
    assert pages["depth"].nunique() > 1
    for row in pages.itertuples():
        assert row.bucket == row.cell >> (16 - row.depth) << (16 - row.depth)


def test_exact_odd_rows(made_docs):
    found = exact.exact_duplicates(made_docs(ODD_ROWS, extra=True)).toPandas()
    assert len(found) == len(ODD_ROWS)
    five = found[found["doc_id"] == 5]
    assert len(five) == 2 and (five["group_size"] == 4).all() and five["kept"].all()
    empty = found[found["doc_id"].isin([2, 3])]
    assert set(empty["keep_id"]) == {3} and set(empty["text_sha256"]) == {hashlib.sha256(b"").hexdigest()}
    lone = found[found["doc_id"].isna()]
    assert not lone["kept"].any() and sorted(lone["keep_id"].fillna(-1)) == [-1, 5]


def test_exact_empty_table(made_docs):
    assert exact.exact_duplicates(made_docs([])).count() == 0
    assert exact.without_duplicates(made_docs([])).count() == 0


def test_without_duplicates_keeps_the_largest_once(made_docs):
    kept = exact.without_duplicates(made_docs(ODD_ROWS, extra=True))
    assert "features" in kept.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 3, 4, 5, 6, 7, 9, 10]


def plain_fingerprint(text):
    table = {c: c + 32 for c in range(65, 91)}
    words = (text or "").encode().translate(bytes(table.get(c, c) for c in range(256))).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, prints):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    least = ids.copy()
    while True:
        after = np.where(near, least[None, :], ids.max() + 1).min(axis=1)
        if (after == least).all():
            return least
        least = after


def test_simhash_equals_brute_force(documents, texts):
    found = in_order(simhash.simhash_groups(documents), "doc_id")
    prints = np.array([plain_fingerprint(texts[i]) for i in found["doc_id"]], np.uint64)
    assert [f"{p:016x}" for p in prints.tolist()] == found["fingerprint"].tolist()
    assert (found["component_id"].to_numpy() == brute_components(found["doc_id"].to_numpy(), prints)).all()


def test_links_are_all_found_once(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(6):
            other = base
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                other ^= 1 << bit
            prints.add(other)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    for most in (4, 2):
        found = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), most).collect()]
        wanted = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= most}
        assert len(found) == len(set(found)) and set(found) == wanted
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 5)


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_popcount_distance_bounds_hamming(a, b):
    def counts(x):
        return [(x >> i & 1) + (x >> i + 1 & 1) for i in range(0, 64, 2)]

    assert sum(abs(x - y) for x, y in zip(counts(a), counts(b), strict=True)) <= (a ^ b).bit_count()


def test_simhash_odd_rows(made_docs):
    rows = [*ODD_ROWS, (11, LONG * 12)]
    found = simhash.simhash_groups(made_docs(rows, extra=True)).toPandas()
    assert len(found) == len(rows)
    blank = found[found["doc_id"].isin([2, 3, 4])]
    assert set(blank["fingerprint"]) == {"0" * 16} and set(blank["component_id"]) == {2}
    for doc, text in rows:
        if doc == 11 or doc == 8:
            assert found[found["doc_id"] == doc]["fingerprint"].iloc[0] == f"{plain_fingerprint(text):016x}"
    assert simhash.simhash_groups(made_docs([])).count() == 0
    kept = simhash.without_near_duplicates(made_docs(rows)).toPandas()
    assert kept["doc_id"].isna().sum() == 2 and {1, 2}.issubset(set(kept["doc_id"].dropna())) and 5 not in set(kept["doc_id"])


@pytest.mark.parametrize("kind", ["path", "random", "star", "none"])
def test_components_equal_union_find(spark, kind):
    rng = random.Random(5)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "star": [(99, i) for i in range(50)] + [(200, 201), (201, 202)],
        "none": [],
    }[kind]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    found = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}
