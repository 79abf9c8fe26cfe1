"""Words of a text and their token ids, with caches that live as long as a Python worker.

The tokenizers here never join characters across a blank or a line feed, so a text's ids are
the ids of its pieces in a row. Equal pieces are encoded once per worker and kept in a cache of
bounded size; the library encodes every piece itself.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

CACHE_ENTRIES = 1_000_000
CACHED_LENGTH = 64  # longer pieces are rare, and would make the cache's memory unbounded


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Cache:
    """piece -> value in two generations: when the young one is full it becomes the old one."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.half = max(1, entries // 2)
        self.young: dict = {}
        self.old: dict = {}

    def fill(self, pieces: Iterable[str], make: Callable[[list[str]], list]) -> dict:
        """Values of all distinct pieces; those not known are made at once."""
        young, old, out, missing = self.young, self.old, {}, []
        for piece in set(pieces):
            value = young.get(piece)
            if value is None:
                value = old.get(piece)
                if value is None:
                    missing.append(piece)
                    continue
                young[piece] = value
            out[piece] = value
        for piece, value in zip(missing, make(missing) if missing else ()):
            out[piece] = value
            if len(piece) <= CACHED_LENGTH:
                young[piece] = value
        if len(young) > self.half:
            self.young, self.old = {}, young
        return out


class Memo(dict):
    """piece -> value, made when it is first looked up, so that known pieces cost no Python code.

    Two generations as in ``Cache``: this dict is the young one.
    """

    def __init__(self, make: Callable[[str], int], entries: int = CACHE_ENTRIES):
        self.make, self.half, self.old = make, max(1, entries // 2), {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= self.half:
                self.old.clear()
                self.old.update(self)
                self.clear()
            self[piece] = value
        return value
