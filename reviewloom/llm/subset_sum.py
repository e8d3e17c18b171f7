"""Bounded subset sums over lengths with counts, by bit sets."""

from __future__ import annotations


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Which multiset of lengths comes closest to ``room`` without going over it.

    Bit s of a set says that sum s can be reached. Each length widens the set by up to its
    count, in copies of 1, 2, 4 ...; the sets before each length are kept, and the counts are
    read off backwards. Lengths are tried in the given order; the work stops when ``room``
    itself is reached. Lengths of 0 are never taken.
    """
    mask = (1 << (room + 1)) - 1
    bits, before = 1, []
    for length in lengths:
        most = min(counts.get(length, 0), room // length) if length > 0 else 0
        if most <= 0:
            continue
        before.append((length, most, bits))
        copies = 1
        while most > 0:
            step = min(copies, most)
            bits |= (bits << (step * length)) & mask
            most -= step
            copies *= 2
        if bits >> room & 1:
            break
    at, taken = bits.bit_length() - 1, {}
    for length, most, seen in reversed(before):
        copies = next(k for k in range(most + 1) if at >= k * length and seen >> (at - k * length) & 1)
        if copies:
            taken[length] = copies
            at -= copies * length
    return taken
