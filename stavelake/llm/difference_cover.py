"""Suffix sorting by a difference cover modulo 3, in arrays.

Positions that are 1 or 2 modulo 3 are the sample.  Their triples are sorted and named; unless the names are unique, the string
of names is sorted the same way.  The remaining suffixes are sorted by their first symbol and the rank of the next
position, and merged: against positions 1 modulo 3 by (symbol, rank of the next), against positions 2 modulo 3 by (symbol,
symbol, rank of the one after), which are sample positions on both sides.
"""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (int64, symbols of 1 and up) in ascending order.

    Keys of three names must fit into 63 bits: up to 2 million symbols.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    if n >= 1 << 21:
        raise ValueError("too long for keys of 63 bits")
    symbols = int(s.max()) + 1
    if symbols >= 1 << 21:  # sparse alphabet
        s = np.unique(s, return_inverse=True)[1] + 1
        symbols = int(s.max()) + 1
    t = np.concatenate([s, np.zeros(3, np.int64)])
    extra = n + (n % 3 == 1)  # a dummy sample position, so that the names of both classes are kept apart
    ones, twos = np.arange(1, extra, 3), np.arange(2, extra, 3)
    sample = np.concatenate([ones, twos])
    triple = (t[sample] * symbols + t[sample + 1]) * symbols + t[sample + 2]
    order = np.argsort(triple)
    ordered = triple[order]
    named = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if named[-1] < len(sample):
        names = np.empty(len(sample), np.int64)
        names[order] = named
        order = suffix_order(names)
    sorted_sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    ranks = len(sample) + 2

    rest = np.arange(0, n, 3)
    by_one = lambda p: t[p] * ranks + rank[p + 1]
    by_two = lambda p: (t[p] * symbols + t[p + 1]) * ranks + rank[p + 2]
    rest = rest[np.argsort(by_one(rest))]
    first, second = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    place = np.arange(len(rest)) + np.searchsorted(by_one(first), by_one(rest)) + np.searchsorted(by_two(second), by_two(rest))
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = sorted_sample
    return out


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` bytes also start elsewhere in these strings (booleans).

    The strings are joined by symbols that occur once, their suffixes sorted, and the first ``length`` bytes of
    neighbours in that order compared.
    """
    sizes = np.array([len(x) for x in strings])
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    n = int(ends[-1])
    raw = np.frombuffer(b"\0".join(strings) + bytes(9 + length), np.uint8)
    symbols = raw[:n].astype(np.int64) + len(strings) + 1
    symbols[ends - 1] = np.arange(1, len(strings) + 1)
    starts = np.zeros(n, bool)
    for b, size in zip(begins, sizes, strict=True):
        if size >= length:
            starts[b : b + size - length + 1] = True
    order = suffix_order(symbols)
    order = order[starts[order]]
    words = np.empty(n + length, np.uint64)
    for k in range(8):
        part = words[k::8]
        part[:] = np.frombuffer(raw[k : k + 8 * len(part)].tobytes().ljust(8 * len(part), b"\0"), "<u8")
    alive = np.arange(max(len(order) - 1, 0))
    steps = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    for at in steps:
        alive = alive[words[order[alive] + at] == words[order[alive + 1] + at]]
    for at in range(length) if length < 8 else []:
        alive = alive[raw[order[alive] + at] == raw[order[alive + 1] + at]]
    twice = np.zeros(n, bool)
    twice[order[alive]] = True
    twice[order[alive + 1]] = True
    return [twice[b : b + max(size - length + 1, 0)] for b, size in zip(begins, sizes, strict=True)]
