"""Token ids of two public vocabularies, inside tasks. Paths of vocabulary files are parameters; nothing is trained."""

from __future__ import annotations

import base64
import json
import sys
import types
from collections.abc import Callable

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

PACKING_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ENCODING_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PLAIN = 0x250
"""Characters below this point (Latin) are split alike by every version of the Unicode tables."""


def once(key: tuple, make: Callable):
    """What ``make`` gives, made once in each worker process, whichever task asks first."""
    kept = vars(sys.modules.setdefault("wardbook_worker", types.ModuleType("wardbook_worker")))
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _encoding(name: str, ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def rank_encoder(path: str) -> tiktoken.Encoding:
    """The encoder of a file of ranks."""

    def make() -> tiktoken.Encoding:
        with open(path, "rb") as lines:
            return _encoding("ranks", {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    return once(("ranks", path), make)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    return letters | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def _pair(path: str) -> tuple[Tokenizer, tiktoken.Encoding, list[str]]:
    """A ``tokenizers`` file, its vocabulary as ranks, and its added tokens.

    In a byte-level vocabulary whose merges are numbered in the order they apply,
    ids are ranks, so both libraries give the same ids; the second is four times
    as fast. Tests compare them.
    """
    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    letters = byte_letters()
    added = exact.get_added_tokens_decoder()
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if i not in added}
    return exact, _encoding("vocabulary", ranks), [t.content for t in added.values()]


def vocabulary_ids(text: str, path: str = PACKING_VOCABULARY) -> np.ndarray:
    """Ids of a text by a ``tokenizers`` file, as unsigned 32-bit numbers: nothing is added at its ends.

    Texts with characters beyond Latin, where libraries may differ in what is a
    letter, and texts that spell an added token, which is then that one id, go
    through ``tokenizers`` itself.
    """
    exact, fast, added = once(("vocabulary", path), lambda: _pair(path))
    if (text.isascii() or ord(max(text)) < PLAIN) and not any(t in text for t in added):
        return fast.encode_to_numpy(text, disallowed_special=())
    return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)


def rank_ids(text: str, path: str = ENCODING_VOCABULARY) -> np.ndarray:
    return rank_encoder(path).encode_to_numpy(text, disallowed_special=())
