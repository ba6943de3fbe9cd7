"""Byte-level BPE ids from a public vocabulary file."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public vocabulary of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_pattern() -> str:
    """The pattern by which the public byte-level vocabularies cut a text."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file; strings of special tokens are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


def ids_with_special(encoding: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """The ids of a whole text as ``tokenizers`` has them: ``SPECIAL`` is one id."""
    if not text or SPECIAL not in text:
        return ids(encoding, text)
    first, *rest = text.split(SPECIAL)
    parts = [ids(encoding, first)]
    for part in rest:
        parts += [np.array([SPECIAL_ID], dtype=np.uint32), ids(encoding, part)]
    return np.concatenate(parts)


def ids(encoding: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """The ids of a whole text; a null text has none."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    return encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
