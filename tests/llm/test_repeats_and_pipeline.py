from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

import __spark_entry__ as entry_module
import corpus_pipeline
from tests.llm.conftest import ODD_ROWS, in_order
from tests.llm.test_exact_and_simhash import brute_components, plain_fingerprint
from wardbook.llm import passages, queries, repeats, substrings, toxicity
from wardbook.llm.support import written


def brute(rows, split, join, window):
    """Digests by a plain scan in order of ids; rows without one are left alone."""
    first: dict = {}
    out = []
    for doc, text in rows:
        parts = split((text or "").encode())
        if doc is not None:
            for i in range(len(parts) - window + 1):
                key = join(parts[i : i + window])
                first[key] = min(doc, first.get(key, doc))
    for doc, text in rows:
        parts = split((text or "").encode())
        gone = np.zeros(len(parts), bool)
        if doc is not None:
            for i in range(len(parts) - window + 1):
                if first[join(parts[i : i + window])] < doc:
                    gone[i : i + window] = True
        kept = join([p for p, g in zip(parts, gone, strict=True) if not g])
        spans = int((np.diff(np.r_[False, gone].astype(int)) > 0).sum())
        out.append((doc, len(parts), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(rows):
    return brute(rows, lambda b: [b[i : i + 1] for i in range(len(b))], b"".join, 50)


def brute_words(rows):
    return [(d, n, r, h) for d, n, r, _, h in brute(rows, bytes.split, b" ".join, 13)]


def key(row):
    return tuple((v is None or v != v, 0 if v is None or v != v else v) for v in row)


def same(found, wanted):
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows, key=key) == sorted(wanted, key=key)


OPTIONS = [{}, {"part_bytes": 40_000}, {"part_bytes": 60_000, "giant": 2}]


@pytest.mark.parametrize("options", OPTIONS)
def test_bytes_equal_brute_force(documents, texts, options):
    same(substrings.suffix_dedup(documents, **options), brute_bytes(sorted(texts.items())))


@pytest.mark.parametrize("options", OPTIONS)
def test_words_equal_brute_force(documents, texts, options):
    same(passages.passage_dedup(documents, **options), brute_words(sorted(texts.items())))


REPEAT = "a passage that is long enough to be found in more than one document, word for word and byte for byte, twice "
EXTRA = [
    (20, "before " + REPEAT + "after"),
    (21, "other " + REPEAT * 2 + "words"),
    (19, REPEAT[10:80] + "x" + REPEAT[30:]),
    (22, "z" * 49),
    (23, "z" * 49 + "é"),
    (24, "z" * 120),
    (25, "w " * 12),
    (26, "w " * 13),
    (27, "w " * 40),
]


@pytest.mark.parametrize("options", [{}, {"part_bytes": 20_000}, {"part_bytes": 20_000, "giant": 0}])
def test_odd_rows(made_docs, options):
    rows = [*ODD_ROWS, *EXTRA]
    docs = made_docs(rows, extra=True)
    same(substrings.suffix_dedup(docs, **options), brute_bytes(rows))
    same(passages.passage_dedup(docs, **options), brute_words(rows))


def test_empty_tables_and_real_outputs(made_docs):
    empty = made_docs([])
    assert substrings.suffix_dedup(empty).count() == passages.passage_dedup(empty).count() == 0
    assert passages.without_passages(empty).columns == empty.columns
    docs = made_docs(EXTRA, extra=True)
    for r in substrings.suffix_dedup(docs, with_bytes=True).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    words = {r["doc_id"]: r for r in passages.passage_dedup(docs, with_text=True).collect()}
    for r in passages.without_passages(docs).collect():
        text = dict(EXTRA)[r["doc_id"]]
        assert r["text"] == (words[r["doc_id"]]["kept"] if words[r["doc_id"]]["n_removed"] else text)
        assert r["n_chars"] == len(r["text"])
    odd = {r["doc_id"]: r for r in passages.without_passages(made_docs(ODD_ROWS)).collect()}
    assert odd[2]["text"] is None and odd[3]["text"] == ""


def test_long_documents_go_block_by_block(monkeypatch):
    text = (REPEAT * 3 + "middle").encode()
    whole = repeats.runs_of(substrings.split_bytes([text]), substrings.BYTES)
    monkeypatch.setattr(repeats, "_BLOCK", 37)
    cut = repeats.runs_of(substrings.split_bytes([text]), substrings.BYTES)
    assert whole.size.sum() == cut.size.sum() == len(text) - 49
    assert np.repeat(whole.anchor, whole.size).tolist() == np.repeat(cut.anchor, cut.size).tolist()


@settings(max_examples=50, deadline=None)
@given(hnp.arrays(np.uint64, st.tuples(st.integers(1, 30), st.integers(1, 4)), elements=st.integers(0, 2)))
def test_multikey_groups_are_those_of_equal_rows(words):
    group = substrings.multikey_groups(words)
    rows = [tuple(r) for r in words.tolist()]
    for i in range(len(rows)):
        for j in range(i):
            assert (group[i] == group[j]) == (rows[i] == rows[j])
            assert (group[i] < group[j]) == (rows[i] < rows[j])


def test_sampled_splitters_are_ordered(documents):
    cuts = substrings.splitters(documents, 8)
    assert len(cuts) == 7 and cuts == sorted(set(cuts)) and all(len(c) == substrings.SEED for c in cuts)


def brute_pipeline(rows, toxic):
    """What the stages keep, in plain Python, given the documents that the first one rejects."""
    kept = {d: t for d, t in rows if d not in toxic}
    by_text: dict = {}
    for d, t in kept.items():
        by_text[t] = max(d, by_text.get(t, d))
    kept = {d: t for d, t in kept.items() if by_text[t] == d}
    ids = np.array(sorted(kept))
    least = brute_components(ids, np.array([plain_fingerprint(kept[d]) for d in ids], np.uint64))
    kept = {d: kept[d] for d, c in zip(ids.tolist(), least.tolist(), strict=True) if d == c}
    out = {}
    for (d, t), (_, _, removed, digest) in zip(sorted(kept.items()), brute_words(sorted(kept.items())), strict=True):
        out[d] = (removed, digest if removed else hashlib.sha256(t.encode()).hexdigest())
    return out


def test_pipeline_equals_plain_python(spark, small_dir, documents, texts):
    docs, results = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = results[name] = written(stage(spark, docs, small_dir))
        if name != "packing":
            assert docs.columns == documents.columns
    kept = {r["doc_id"] for r in results["toxicity"].collect()}
    model = toxicity.train(documents, spark.read.parquet(f"{small_dir}/labels.parquet"))
    rejected = {r["row"]["doc_id"] for r in model.score(documents).filter("predicted = 1").collect()}
    assert kept == set(texts) - rejected and len(rejected) < len(texts) / 5
    wanted = brute_pipeline(sorted(texts.items()), rejected)
    cut = {r["doc_id"]: r["text"] for r in results["substring_dedup"].collect()}
    assert set(cut) == set(wanted)
    assert all(hashlib.sha256(cut[d].encode()).hexdigest() == digest for d, (_, digest) in wanted.items())
    assert {r["doc_id"] for r in results["packing"].collect()} == set(wanted)


def test_pipeline_odd_rows(spark, small_dir, made_docs):
    for rows in (ODD_ROWS, []):
        docs = made_docs(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, small_dir))
        assert docs.columns[:2] == ["doc_id", "piece"] and (docs.count() > 0) == bool(rows)


def test_queries_are_registered(spark, small_dir):
    known = entry_module.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in known if k.startswith("op")) == list(range(1, 14))
    assert "pipeline" in known and set(queries.ORACLE_SQL) <= set(known)
    columns = {
        "op1": ["vec_id", "n_links", "component_id", "kept"],
        "op2": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op3": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op4": ["doc_id", "fingerprint", "component_id"],
        "op5": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op7": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op9": ["doc_id", "held_out", "lang_pred", "score"],
        "op10": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op11": ["page_id", "url", "text", "n_chars"],
        "op12": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
        "op13": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    }
    for name, query in queries.QUERIES.items():
        if name.split("_")[0] in columns:
            frame = query(spark, small_dir)
            assert frame.columns == columns[name.split("_")[0]]


def in_id_order(frame):
    return in_order(frame, "doc_id")


def test_rows_without_an_id_or_of_one_id_spread(made_docs):
    """Rows without an id go into no part; those of one id into several."""
    rows = [(None, f"{i} {REPEAT}") for i in range(100)] + [(7, f"{i} {REPEAT}") for i in range(100)] + EXTRA
    docs = made_docs(rows)
    same(substrings.suffix_dedup(docs, part_bytes=2000), brute_bytes(rows))
    same(passages.passage_dedup(docs, part_bytes=2000), brute_words(rows))
    kept = sorted(r["text"] for r in passages.without_passages(docs, part_bytes=2000).collect() if r["doc_id"] is None)
    assert kept == sorted(t for d, t in rows if d is None)

    def finish(frame, _):
        return frame[["doc_id"]].astype({"doc_id": "Int64"}).assign(rows=len(frame), dealt="part" in frame)

    found = repeats.remove_repeats(docs, passages.WORDS, None, passages.edge_minima, finish, "doc_id long, rows long, dealt boolean", 2000)
    parts = found.collect()
    assert len(parts) == len(rows) and not any(r["dealt"] for r in parts if r["doc_id"] is None)
    assert max(r["rows"] for r in parts if r["doc_id"] == 7) < 50


@pytest.mark.parametrize("name", ["__part", "part", "PART", "part_"])
def test_columns_of_any_name_are_carried(spark, name):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, "first"), (2, "before " + text + " after", "second"), (None, text, "third")]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` string")
    found = sorted(map(tuple, passages.without_passages(docs).collect()), key=lambda r: r[2])
    assert found == [(1, text, "first"), (2, "before after", "second"), (None, text, "third")]
    assert passages.passage_dedup(docs).count() == substrings.suffix_dedup(docs).count() == 3


def test_giant_seeds_are_seen_however_few_parts(made_docs):
    """A seed with more than 255 runs in one part counts in full, so its windows are dealt out one by one."""
    rng = np.random.default_rng(7)
    seed = " ".join(f"s{i}" for i in range(6))
    text = " ".join(" ".join(f"r{x}" for x in rng.integers(0, 10**9, 8)) + " " + seed for _ in range(400))
    frame = made_docs([(1, text), (2, text[::-1])]).toPandas()
    batches = repeats.batches_of(frame, passages.WORDS)
    counts = repeats.seeds_of(batches)[2]
    assert counts.max() > 255
    messages = repeats.tell_seeds(frame, 0, passages.WORDS, 0)
    other = messages.assign(part=1)
    flags = repeats.compare_seeds(pd.concat([messages, other]), giant=600)["flags"].iloc[0]
    assert (np.frombuffer(flags, np.uint8) & 2).any() == (2 * counts.max() > 600)


def test_blocks_cut_no_run(monkeypatch):
    texts = [(REPEAT * 3 + "middle").encode(), b"", b"short", (REPEAT + "end").encode()]
    whole = repeats.runs_of(substrings.split_bytes(texts), substrings.BYTES)
    monkeypatch.setattr(repeats, "_BLOCK", 37)
    again = repeats.runs_of(substrings.split_bytes(texts), substrings.BYTES)
    for name in ("doc", "first", "size", "seed", "anchor"):
        assert getattr(whole, name).tolist() == getattr(again, name).tolist()


@pytest.mark.parametrize("giant", [False, True])
def test_entries_do_not_depend_on_the_order_of_rows(made_docs, monkeypatch, giant):
    """The second and the third step find the same entries, though a part's rows may come in another order."""
    monkeypatch.setattr(repeats, "_BATCH_BYTES", 300)
    frame = made_docs([(i, f"{i % 3} {REPEAT} {i}") for i in range(12)]).toPandas()
    unit, found = substrings.BYTES, []
    for rows in (frame, frame[::-1].reset_index(drop=True)):
        batches = repeats.batches_of(rows, unit)
        seed = repeats.seeds_of(batches)[0]
        flags = np.full(len(seed), 1 + 2 * giant, np.uint8).tobytes()
        shared = repeats.Shared.of(batches, pd.DataFrame({"bucket": [0], "flags": [flags]}))
        entries = repeats.entries_of(batches, shared, unit, lambda s: s[0] % 5, 5)
        assert entries.bucket.tolist() == sorted(entries.bucket.tolist())
        for batch, (runs, entry) in zip(batches, entries.runs, strict=True):
            low, high = batch.elements.bounds(runs.first, runs.first + runs.size + unit.window - 2)
            assert [entries.text[e] for e in entry.tolist()] == [batch.elements.buffer[a:b] for a, b in zip(low, high, strict=True)]
        found.append((entries.bucket.tolist(), entries.text, entries.seed.tolist(), entries.doc.tolist()))
    assert len(found[0][1]) > 5 and found[0] == found[1]
