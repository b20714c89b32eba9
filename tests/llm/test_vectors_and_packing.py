from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_ROWS, in_order
from wardbook.llm import packing, tokens, vectors
from wardbook.llm.support import shared_folder

VECTOR = "vec_id long, embedding array<float>, label int"


def brute_links(ids, rows, threshold):
    unit = np.stack([np.asarray(r, float) for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    least = ids.copy()
    while True:
        after = np.minimum(least, np.where(linked, least[None, :], ids.max() + 1).min(axis=1))
        if (after == least).all():
            return linked.sum(axis=1), least
        least = after


@pytest.mark.parametrize(
    "options",
    [{}, {"pivot_rows": 20, "block_rows": 30}, {"min_cosine": 0.3, "pivot_rows": 40, "block_rows": 64}, {"min_cosine": 0.99}],
)
def test_links_equal_brute_force(spark, small_dir, options):
    frame = spark.read.parquet(f"{small_dir}/embeddings.parquet").limit(300)
    dense = spark.createDataFrame(
        [(1000 + i, [1.0, i / 40] + [0.1] * 62, 0) for i in range(40)] + [(2000 + i, [1.0] * 64, 0) for i in range(30)], VECTOR
    )
    frame = frame.select("vec_id", "embedding", "label").union(dense)
    rows = in_order(frame, "vec_id")
    links, least = brute_links(rows["vec_id"].to_numpy(), rows["embedding"], options.get("min_cosine", 0.9))
    found = in_order(vectors.near_vectors(frame, **options), "vec_id")
    assert (found["n_links"].to_numpy() == links).all()
    assert (found["component_id"].to_numpy() == least).all()
    assert (found["kept"] == (found["vec_id"] == found["component_id"])).all()


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0),
        (2, [2.0, 0.0], 1),
        (3, [1.0, 0.0], None),
        (3, [1.0, 0.0], None),
        (4, None, 0),
        (5, [], 0),
        (6, [0.0, 0.0], 0),
        (7, [1.0, None], 0),
        (8, [nan, 1.0], 0),
        (9, [inf, 1.0], 0),
        (10, [1.0, 0.0, 0.0], 0),
        (11, [1.0, 0.0, 0.0], 0),
        (None, [1.0, 0.0], 0),
    ]
    found = in_order(vectors.near_vectors(spark.createDataFrame(rows, VECTOR).selectExpr("*", "1 as low", "2 as size")), "vec_id")
    by = found.groupby("vec_id")["n_links"].max().to_dict()
    assert by == {1: 3, 2: 3, 3: 3, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 1, 11: 1}
    assert found[found["vec_id"].isin([1, 2, 3])]["component_id"].eq(1).all()
    assert found[found["vec_id"].isna()]["n_links"].tolist() == [0]
    assert len(found) == len(rows)
    assert vectors.near_vectors(spark.createDataFrame([], VECTOR)).count() == 0


def folder_bytes(spark):
    folder = shared_folder(spark).removeprefix("file://")
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_vectors_are_not_copied_for_each_cell(spark):
    """Vectors at random lie near all cells' borders: what is written stays a small multiple of them, however many the cells."""
    rng = np.random.default_rng(3)
    rows = rng.standard_normal((2000, 64))
    rows[1000:1040] = rows[0] + rng.standard_normal((40, 64)) * 0.02
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows.tolist())], VECTOR).repartition(4)
    before = folder_bytes(spark)
    found = in_order(vectors.near_vectors(frame, pivot_rows=20, block_rows=100), "vec_id")
    assert folder_bytes(spark) - before < 5 * rows.astype(np.float32).nbytes
    links, least = brute_links(np.arange(2000), rows.astype(np.float32), 0.9)
    assert (found["n_links"].to_numpy() == links).all() and links[0] == 40
    assert (found["component_id"].to_numpy() == least).all()


def test_batches_of_vectors_stay_small(spark):
    """A batch of vectors far from any structure gives one row for each, and a block of them is one row of its own bytes."""
    rng = np.random.default_rng(4)
    pivots = vectors._unit(rng.standard_normal((512, 64)))
    values = pa.array(rng.standard_normal(64 * 3000).astype(np.float32))
    lists = pa.ListArray.from_arrays(pa.array(range(0, 64 * 3000 + 1, 64), pa.int32()), values)
    ids = pa.array(range(3000), pa.int64())
    batch = pa.record_batch({"k1": ids, "k2": ids, "embedding": lists, "low": ids, "size": ids})
    (homes,) = vectors.homes_of(iter([batch]), pivots)
    assert homes.num_rows == 3000 and len(set(homes["cell"].to_pylist())) > 400
    table = pa.Table.from_batches([homes]).append_column("chunk", pa.repeat(pa.scalar(0, pa.int32()), 3000))
    assert vectors.packed(table, pivots).nbytes < 1.2 * table.nbytes


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_within_each_dimension(spark, kind):
    rng = np.random.default_rng(5)
    rows, ids = [], []
    for width, of in ((3, 0), (8, 1000), (1, 2000)):
        some = rng.standard_normal((150, width)).astype(np.float32).astype(float)
        rows += some.tolist()
        ids += range(of, of + 150)
    frame = spark.createDataFrame([*zip(ids, rows, [0] * 450, strict=True)], f"vec_id long, embedding array<{kind}>, label int")
    found = in_order(vectors.near_vectors(frame.repartition(3), pivot_rows=30, block_rows=16), "vec_id")
    for of in (0, 1000, 2000):
        links, least = brute_links(np.arange(of, of + 150), rows[of * 150 // 1000 :][:150], 0.9)
        part = found[found["vec_id"].between(of, of + 149)]
        assert (part["n_links"].to_numpy() == links).all()
        assert (part["component_id"].to_numpy() == least).all()


def check_places(found, texts):
    for doc, group in found.groupby("doc_id"):
        ids = packing.token_ids(texts[doc], tokens.PACKING_VOCABULARY, 2)
        group = group.sort_values("piece")
        assert group["piece"].tolist() == list(range(len(group)))
        assert group["start"].tolist() == [0, *group["length"].cumsum()[:-1]] and group["length"].sum() == len(ids)
        assert len(group) == 1 or (group["length"].iloc[1:] == 1024).all()
        for r in group.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, group in found.sort_values("offset").groupby("sequence_id"):
        assert group["offset"].tolist() == [0, *group["length"].cumsum()[:-1]]
        assert group["length"].sum() <= 1024


@pytest.mark.parametrize("options", [{}, {"part_pieces": 9, "fan_in": 3}])
def test_packing_places_everything(documents, texts, options):
    found = packing.pack(documents, **options).toPandas()
    assert found["doc_id"].nunique() == len(texts)
    check_places(found, texts)
    least = -(-found["length"].sum() // 1024)
    assert found["sequence_id"].nunique() <= least * (1.02 if not options else 1.15) + 1


def test_merge_rounds_save_sequences(documents):
    parts = packing.pack(documents, part_pieces=9, fan_in=4).select("sequence_id").distinct().count()
    alone = packing.pack(documents, part_pieces=9, fan_in=4)
    assert parts == alone.select("sequence_id").distinct().count()
    pieces = [r["length"] for r in alone.collect()]
    best = len(packing.best_fit(np.array(pieces), 1024)[2])
    assert best <= parts <= best * 1.1 + 1


def test_sequences_hold_the_ids(documents, texts):
    places = packing.pack(documents)
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(documents, places).collect()}
    for r in places.collect():
        ids = packing.token_ids(texts[r["doc_id"]], tokens.PACKING_VOCABULARY, 2)
        assert rows[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["start"] : r["start"] + r["length"]].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_best_fit_leaves_no_two_bins_that_fit_together(sizes):
    bins, offsets, fill = packing.best_fit(np.array(sizes, int), 50)
    for b in range(len(fill)):
        own = np.flatnonzero(bins == b)
        assert sum(sizes[i] for i in own) == fill[b] <= 50
    ordered = sorted(fill)
    assert len(ordered) < 2 or ordered[0] + ordered[1] > 50
    keep = packing.carried(fill, 50, 3)
    assert keep.sum() <= 4


def test_cut_shortens_the_first_piece_only():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_packing_odd_rows(made_docs):
    found = packing.pack(made_docs(ODD_ROWS, extra=True)).toPandas()
    assert found[found["doc_id"].isin([2, 3])]["length"].tolist() == [1, 1]
    assert len(found[found["doc_id"] == 5]) == 2 and found["doc_id"].isna().sum() == 2
    known = found[found["doc_id"].notna() & (found["doc_id"] != 5)]
    check_places(pd.concat([known]).assign(sequence_id=range(len(known)), offset=0), dict(ODD_ROWS))
    assert packing.pack(made_docs([])).count() == 0


@pytest.fixture(scope="module")
def fresh():
    """The vocabulary as its library reads it, with nothing set."""
    return Tokenizer.from_file(tokens.PACKING_VOCABULARY)


MARK = "<|endoftext|>"
SPECIAL = [MARK, f"a {MARK} b", f"x{MARK}{MARK}y", f"汉{MARK}", f" {MARK}\n", "<|endoftext|", "<|ENDOFTEXT|>", f"{MARK[:5]}{MARK}"]


@pytest.mark.parametrize("text", SPECIAL)
def test_added_tokens_are_their_own_ids(fresh, text):
    wanted = fresh.encode(text, add_special_tokens=False).ids
    assert tokens.vocabulary_ids(text).tolist() == wanted
    assert (50256 in wanted) == (MARK in text)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(max_codepoint=0x24F), max_size=80) | st.text(max_size=40) | st.lists(st.sampled_from([*"ab <|>", MARK])).map("".join))
def test_both_libraries_give_the_same_ids(fresh, text):
    assert tokens.vocabulary_ids(text).tolist() == fresh.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("options", [{}, {"part_pieces": 9, "fan_in": 3}])
def test_packing_against_a_plain_check(spark, made_docs, fresh, options):
    """The query's rows from the contract's words alone: ids by the library, pieces, places, and no waste that best fit would not have."""
    rows = [*ODD_ROWS, *((100 + i, t) for i, t in enumerate(SPECIAL)), *((200 + i, "word " * n) for i, n in enumerate(range(0, 3000, 37)))]
    rows = [(i, t) for i, t in enumerate(t for _, t in rows)]
    found = packing.pack(made_docs(rows), **options).collect()
    whole = {i: [*fresh.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    got, bins = {}, {}
    for r in found:
        got.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    assert set(got) == set(whole)
    for doc, some in got.items():
        some.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in some] == list(range(len(some)))
        at = 0
        for r in some:
            ids = whole[doc][at : at + r["length"]]
            assert (r["start"], len(ids)) == (at, r["length"])
            assert r["ids_crc32"] == zlib.crc32(b"".join(struct.pack("<I", i) for i in ids))
            at += r["length"]
        assert at == len(whole[doc]) and all(r["length"] == 1024 for r in some[1:])
    for some in bins.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    fill = sorted(sum(r["length"] for r in some) for some in bins.values())
    least = -(-sum(map(len, whole.values())) // 1024)
    assert len(bins) <= least * (1.03 if not options else 1.15) + 1
    assert options or fill[0] + fill[1] > 1024
