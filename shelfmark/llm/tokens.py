"""Token ids of a byte-level BPE vocabulary file.

The vocabulary is read from the ``tokenizers`` JSON file. Where that file is a plain
byte-level BPE (no normaliser, ids in merge order) the same ids are made by
``tiktoken``, several times faster; any other file goes through ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

# Fixed value: the splitting pattern of the byte-level pre-tokenizer, and the same without its look-ahead.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

_RUN_OF_SPACE = re.compile(r"\s\s")


def resolve(vocabulary: str) -> str:
    """A path as it is, or the name of a file of the public vocabularies installed on this node."""
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def _byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings by rank, if the file is a plain byte-level BPE whose ids follow its merges."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not spec.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    )
    if not plain:
        return None
    alphabet, vocab, special = _byte_alphabet(), model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)):
        return None
    return {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}


def _added(spec: dict) -> dict[str, int] | None:
    """Ids of the file's added tokens by their text; None if one of them takes more into account than its text."""
    tokens = spec.get("added_tokens", [])
    if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")):
        return None
    return {t["content"]: t["id"] for t in tokens}


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """Function from a text to its ids (uint32 array), as the library gives them without special tokens of its own.

    A text is split at the file's added tokens first, so that ``<|endoftext|>`` in a text
    is that token's id, as it is for the library.
    """
    path = resolve(vocabulary)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks, added = _ranks(spec), _added(spec)
    if ranks is None or added is None:
        return _library(path)
    import tiktoken

    both = [tiktoken.Encoding("bpe", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (SPLIT, SPLIT_SINGLE)]
    apart = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

    def plain(text: str) -> list[int]:
        single = _RUN_OF_SPACE.search(text) is None  # then the look-ahead changes nothing
        return both[single].encode_ordinary(text)

    def encode(text: str) -> np.ndarray:
        if apart is None or apart.search(text) is None:
            return np.asarray(plain(text), dtype="<u4")
        ids, last = [], 0
        for found in apart.finditer(text):
            ids += [*plain(text[last : found.start()]), added[found[0]]]
            last = found.end()
        return np.asarray(ids + plain(text[last:]), dtype="<u4")

    return encode


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
