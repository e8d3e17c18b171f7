"""64-bit hashes of all words of a text, computed on its bytes at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes that are worked on at a time; a part ends at white space, so it may be longer.
PART_BYTES = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 1 << 12
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_NEXT_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64) | np.uint64(1)


_OF_BYTE = _numbers(256, 21)
_OF_LOWER = _OF_BYTE[[x + 32 if 65 <= x <= 90 else x for x in range(256)]]
_OF_PLACE = _numbers(LONG_WORD, 22)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _parts(data: bytes) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(data):
        white = _NEXT_WHITE.search(data, begin + PART_BYTES) if begin + PART_BYTES < len(data) else None
        end = white.start() if white else len(data)
        yield begin, end
        begin = end


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """One hash per word; with ``lower``, A-Z count as a-z.

    A word's hash is a sum over its bytes of a number for the byte times one for its place.
    """
    data = (text or "").encode()
    of_byte = _OF_LOWER if lower else _OF_BYTE
    found = [np.zeros(0, np.uint64)]
    for begin, end in _parts(data):
        part = np.frombuffer(data, np.uint8, end - begin, begin)
        at = np.flatnonzero(~_WHITE[part])
        if not len(at):
            continue
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        lengths = np.diff(first, append=len(at))
        place = np.arange(len(at)) - np.repeat(first, lengths)
        longest = int(lengths.max())
        if longest > LONG_WORD:
            np.minimum(place, LONG_WORD - 1, out=place)
        sums = np.add.reduceat(of_byte[part[at]] * _OF_PLACE[place], first)
        hashes = mixed(sums + lengths.astype(np.uint64))
        for i in np.flatnonzero(lengths > LONG_WORD) if longest > LONG_WORD else ():
            word = part[at[first[i]] : at[first[i]] + lengths[i]].tobytes()
            hashes[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
        found.append(hashes)
    return np.concatenate(found)
