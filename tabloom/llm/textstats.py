"""Counts over a block of texts, taken on the flat UTF-8 bytes of all its texts at once."""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def table_of(characters: str) -> np.ndarray:
    """Look-up table of ASCII characters."""
    out = np.zeros(256, dtype=bool)
    out[list(characters.encode("ascii"))] = True
    return out


class Flat:
    """Bytes of all texts, one after the other, and where each begins."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.begins = np.concatenate(([0], self.ends[:-1])) if len(texts) else self.ends

    def total(self, hits: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked in ``hits``."""
        upto = np.concatenate(([0], np.cumsum(hits, dtype=np.int64)))
        return upto[self.ends] - upto[self.begins]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, code points in words) of each text; a word is a run of bytes that are not space or \\t-\\r."""
        inside = ~SPACES[self.data]
        before = np.empty(len(inside), dtype=bool)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            before[self.begins[self.begins < len(inside)]] = False
        return self.total(inside & ~before), self.total(inside & ((self.data & 0xC0) != 0x80))


def repeated_windows(texts: list[list[bytes]], size: int = 5) -> np.ndarray:
    """Words of each text in windows of ``size`` words that occur at least twice in it, the first included.

    One sort over hashes of all windows of the block finds the texts that may have any; those are
    counted again exactly.
    """
    out = np.zeros(len(texts), dtype=np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(lengths.sum())
    if n < size:
        return out
    hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, n).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    with np.errstate(over="ignore"):
        key = owner[: n - size + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(size):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k:n - size + 1 + k]
    whole = owner[: n - size + 1] == owner[size - 1:]
    key, owner = key[whole], owner[: n - size + 1][whole]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    for row in np.unique(owner[order][1:][same]).tolist():
        out[row] = _exact(texts[row], size)
    return out


def _exact(words: list[bytes], size: int) -> int:
    first: dict[tuple, int] = {}
    marked = bytearray(len(words))
    for i, window in enumerate(zip(*[words[k:] for k in range(size)])):
        at = first.setdefault(window, i)
        if at != i:
            marked[i:i + size] = b"\1" * size
            marked[at:at + size] = b"\1" * size
    return sum(marked)
