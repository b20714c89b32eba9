from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_ROWS
from wardbook.llm import alignment

TEXTS = [
    None, "", " ", "  a", "a ", "a  b", "a\n\nb c\td", "汉字 🙂🙂 ünï ½ x", "<|endoftext|> <s> </s> <0x41> a<|endoftext|>b", "ﬁ",
    "\x00a b", " x y", "𐍈𐍈 ཀྵ ཀྵ x", "don't we'll", "﻿a", "a ▁b", "▁", "a　b c", "\x1ca b \x1c c", "123 4,5 .. !!", "a b", "a b",
]
"""Among them texts that B does not spell: it writes the mark of a space as a space."""


@pytest.fixture(scope="module")
def plain():
    """Ids and bytes of each token by the libraries alone, of whole texts."""
    first = Tokenizer.from_file(alignment.VOCABULARY_A)
    first.encode_special_tokens = True
    second = SentencePieceProcessor(model_file=alignment.VOCABULARY_B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def spell(i):
        piece = second.id_to_piece(i)
        return bytes.fromhex(piece[3:5]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        a = [(i, bytes(byte[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, spell(i)) for i in second.encode(text)]
        return a, b

    return tokens


def ranges(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def aligned_plainly(text, plain):
    """Tokens, groups and linked pairs of a text by the contract's words."""
    if not text:
        return None
    a, b = plain(text)
    if any(b"".join(data for _, data in t) != (" " + text).encode() for t in (a, b)):
        return None
    a, b = ranges(a), ranges(b)
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    groups = []
    for begin, end in zip([0, *cuts], cuts, strict=False):
        sides = [",".join(str(i) for i, s, e in t if begin <= s and e <= end) for t in (a, b)]
        groups.append("|".join(sides))
    pairs, k = [], 0
    for i, s, e in a:
        while b[k][2] <= s:
            k += 1
        j = k
        while j < len(b) and b[j][1] < e:
            pairs.append((i, b[j][0]))
            j += 1
    return len(a), len(b), groups, pairs


def wanted_rows(rows, plain):
    found = [(doc, aligned_plainly(text, plain)) for doc, text in rows]
    count = Counter(pair for _, f in found if f for pair in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc, f in found:
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_best = sum(count[p] == best[p[0]] for p in f[3])
        digest = hashlib.sha256(";".join(f[2]).encode()).hexdigest()
        out.append((doc, f[0], f[1], len(f[2]), len(f[3]), n_best, sum(count[p] for p in f[3]), digest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_against_whole_texts(made_docs, plain, broadcast_pairs):
    rows = [*enumerate(TEXTS), *((100 + (i or 0), t) for i, t in ODD_ROWS), (None, "no id here"), (None, "no id here")]
    found = alignment.alignment(made_docs(rows, extra=True), broadcast_pairs=broadcast_pairs)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=str) == wanted_rows(rows, plain)


def test_alignment_of_the_documents(spark, small_dir, texts, plain):
    found = alignment.op13_alignment(spark, small_dir)
    assert sorted((tuple(r) for r in found.collect()), key=str) == wanted_rows(list(texts.items()), plain)


def test_alignment_of_an_empty_table(made_docs):
    assert alignment.alignment(made_docs([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 1'▁s\n.,é汉🙂\t<x0>"), max_size=40), max_size=6))
def test_slices_against_whole_texts(plain, rows):
    columns = alignment.align_slice(rows, alignment.Memory(alignment.tokenizers(alignment.VOCABULARY_A, alignment.VOCABULARY_B)))
    for k, text in enumerate(rows):
        wanted = aligned_plainly(text, plain) or (0, 0, [], [])
        assert [int(c[k]) for c in columns[:4]] == [wanted[0], wanted[1], len(wanted[2]), len(wanted[3])]
        pairs = Counter(a << alignment.SHIFT | b for a, b in wanted[3])
        assert dict(zip(columns[5][k].as_py(), columns[6][k].as_py(), strict=True)) == pairs
