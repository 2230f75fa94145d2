"""Rank files of public tokenizers, opened once per Python worker."""

from __future__ import annotations

import base64
import functools


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@functools.lru_cache(maxsize=4)
def encoding(path: str, special: tuple[tuple[str, int], ...] = ()):
    """A tiktoken encoding of a rank file; ``special`` tokens are matched in texts."""
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path),
                             special_tokens=dict(special))
