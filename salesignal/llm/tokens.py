"""Words and shingles of whole texts as 64-bit hashes, a batch at a time in numpy.

Two different words or shingles share a hash with odds of 2**-64: a word's hash is a sum of random numbers, one for each pair of place and byte, so no pattern of bytes makes words meet (a polynomial modulo 2**64 has such patterns, whatever its base). Only shingles of two documents that are compared with one another can disturb a result, so those odds do not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text hashed at once: the arrays stay in cache, and a batch of long texts needs no more memory than its longest.
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Places in a word whose random numbers are held in a table; those of later places are made when they are met.
PLACES = 32
_AT = mix(np.arange(1, 256 * PLACES + 1, dtype=np.uint64))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (maximal runs without the six ASCII spaces) of texts, one after another, and the offset of each text's first word, with an end."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    code = (np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)) * 256 + raw[~space]
    late = np.flatnonzero(code >= len(_AT))
    if len(late):
        values = _AT[np.minimum(code, len(_AT) - 1)]
        values[late] = mix(code[late].astype(np.uint64) + np.uint64(1))
    else:
        values = _AT[code]
    hashes = mix(np.add.reduceat(values, firsts)) if len(firsts) else np.zeros(0, np.uint64)
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return hashes, np.searchsorted(starts, offsets)


def shingles_of(parts: Iterable[list[bytes]], k: int) -> Iterator[np.ndarray]:
    """For each text of parts (runs of lower-cased texts) its distinct shingles of k words, sorted. Fewer words: the whole sequence as one; none: empty."""
    odd = mix(np.arange(101, 101 + k, dtype=np.uint64)) | np.uint64(1)
    for part in parts:
        words, at = words_of(part)
        n = max(0, len(words) - k + 1)
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams += words[j : j + n] * odd[j]
        grams = mix(grams)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= k:
                s = np.sort(grams[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield mix(np.array([np.sum(words[a:b] * odd[: b - a])], np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def text_parts(column, size: int = CHUNK, lower: bool = True) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of an Arrow column of binary texts in runs of about size bytes, A-Z lower-cased; null gives no bytes. Only one run is copied out of the batch at a time."""
    first, held, part = 0, 0, []
    for i, t in enumerate(column):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        if part and held + len(raw) > size:
            yield first, part
            first, held, part = i, 0, []
        part.append(raw.lower() if lower else raw)
        held += len(raw) + 1
    if part:
        yield first, part
