"""Ids of whole texts at full speed, with the streaming transducer for the rest.

The vocabulary is read from the public ``tokenizers`` file. Ordinary texts go through the compiled
merge loop of ``tiktoken`` with the same merges; texts with very long runs, on which its pattern
engine would need unbounded stack or time, go through ``bpe.Transducer``. Both give the ids of the
``tokenizers`` library, special tokens included.
"""

from __future__ import annotations

import re
from functools import lru_cache

import tiktoken

from tracemill.llm.bpe import Transducer, transducer

_LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


class Encoder:
    def __init__(self, path: str, pattern: str):
        self._slow: Transducer = transducer(path, pattern)
        ranks = self._slow.merge_ranks()
        self._fast = tiktoken.Encoding("fast", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        special = self._slow.special
        self._special = special
        self._cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def encode(self, text: str) -> list[int]:
        if _LONG_RUN.search(text):
            return self._slow.encode(text)
        if not self._cut or not self._cut.search(text):
            return self._fast.encode_ordinary(text)
        ids: list[int] = []
        for part in self._cut.split(text):
            ids += [self._special[part]] if part in self._special else self._fast.encode_ordinary(part)
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, pattern)
