"""Word hashes, rolling window hashes and packed hash exchange for Arrow tasks.

A packed exchange moves sorted arrays of distinct hashes instead of one row a hash: a
batch of documents sends one row to each hash range, and a hash that is frequent in a
batch travels once. The range number is the hash's top bits, so ranges are even however
skewed the words are.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark import cloudpickle

#: Odd 64-bit multipliers; any odd numbers would do.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1


def text_words(texts: Iterable[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in one list, and the number of words of each text."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    return [w for ws in split for w in ws], np.fromiter(map(len, split), np.int64, len(split))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A stable 64-bit hash of each word; each distinct word is hashed once."""
    table = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """Polynomial hash of each run of ``k`` values, mod 2**64, by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, out, block, size = 0, None, hashes, 1
    while True:
        if k & size:
            part = block[done : done + n]
            out = part if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
            done += size
        if size * 2 > k:
            return mixed(out)
        block = block[: len(block) - size] * np.uint64(pow(base, size, 1 << 64)) + block[size:]
        size *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits, one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def starts_inside(counts: np.ndarray, k: int) -> np.ndarray:
    """Starts of windows of ``k`` words that lie in one text, in the joined words."""
    total = int(counts.sum())
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)
    return np.flatnonzero(left >= k)


def by_range(sorted_hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(range number, slice) for each range of the top ``bits`` bits that has hashes."""
    if not len(sorted_hashes):
        return
    part = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sorted_hashes), np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = np.concatenate([[0], cuts, [len(part)]])
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(part[a]), slice(int(a), int(b))


def ship(spark, value):
    """Broadcast a value of bounded size, with the code of its class."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(shared):
    return pickle.loads(shared.value)


def text_key(text: str | None) -> bytes:
    """A 128-bit key, equal for equal texts; null counts as empty."""
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


#: Code points of texts that are worked on at once in a task, about.
BLOCK_CHARS = 1_000_000


def text_blocks(texts: list[str]) -> Iterator[slice]:
    """Slices of about ``BLOCK_CHARS`` code points, of whole texts."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
