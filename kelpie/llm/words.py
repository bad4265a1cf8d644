"""Words of a text and stable hashes of them, shared by the operators on word runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Runs of letters, digits and combining marks.
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str) -> list[str]:
    """The words of the lower-cased text, as it stands."""
    return WORD.findall(text.lower())


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, the same on every machine; forgets all when it holds ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """Of every code point, whether it belongs to words."""
    out = np.zeros(0x110000, bool)
    for run in WORD.findall("".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)):
        out[[ord(c) for c in run]] = True
    return out


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each), for texts that are lower-cased already.

    All texts are worked on as one array of code points: a word's hash is mixed from the sum, over its code points, of a
    mix of the code point and its place in the word. The same on every machine.
    """
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(_in_words()[points])
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    start = at[first]
    place = at - np.repeat(start, np.diff(np.r_[first, len(at)]))
    with np.errstate(over="ignore"):
        v = points[at].astype(np.uint64) * _M1 + place.astype(np.uint64) * _M2
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        h = mixed(np.add.reduceat(v, first))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return h, np.bincount(np.searchsorted(ends, start, "right"), minlength=len(texts))


def sliced(batch: pa.RecordBatch, column: int, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about so many bytes, one text at least: bounds what a task holds of long texts."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = lengths[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(lengths, before + chars, "right")))
        yield batch.slice(at, end - at)
        at = end


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, order mattering."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = mixed(h[:m] + np.uint64(0x9E3779B97F4A7C15))
        for k in range(1, n):
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + h[k : m + k])
    return out
