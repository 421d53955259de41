"""Which texts hold any of many strings: one scan, whatever the number of strings.

Strings are parted by the largest power of two up to their length, 64 at most.  A hash of every window of so many bytes is
looked up among those of the strings' first windows; where it is found, the window that ends the string is compared by hash
and then the whole string byte by byte, so the answer is exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The longest window, the bytes hashed at once, and how far from a string's start its second window may end.
WIDEST, BLOCK, FARTHEST = 64, 1 << 17, 4096
ODD, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_hashes(data: np.ndarray, widths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hash of the window at each place), by doubling; windows of up to 8 bytes are their own hashes."""
    wanted, width, h = set(widths), 1, data.astype(np.uint64)
    while True:
        if width in wanted:
            yield width, h
        if width >= max(wanted) or len(h) <= width:
            return
        h = h[:-width] | h[width:] << np.uint64(8 * width) if width < 8 else (h[:-width] * ODD) ^ (h[:-width] >> np.uint64(29)) ^ (h[width:] * OTHER)
        width *= 2


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Finder:
    def __init__(self, strings: Iterable[bytes]) -> None:
        found = set(strings)
        self.any = b"" in found  # is in every text
        by_width: dict[int, dict[int, set[bytes]]] = defaultdict(lambda: defaultdict(set))
        for s in found - {b""}:
            by_width[min(WIDEST, 1 << len(s).bit_length() - 1)][len(s)].add(s)
        #: By width: a table of bits of first windows, the windows sorted, and by length the windows of both ends and the strings.
        self.classes: dict[int, tuple] = {}
        for width, by_length in by_width.items():
            firsts, lengths = [], []
            for length, group in sorted(by_length.items()):
                pairs = []
                for s in group:
                    first, last = (self._hash(s[at : at + width], width) for at in (0, self._second(length, width)))
                    firsts.append(first)
                    pairs.append(self._pair(first, last))
                lengths.append((length, np.unique(np.concatenate(pairs)), group))
            sorted_firsts = np.unique(np.concatenate(firsts))
            bits = min(24, max(16, len(sorted_firsts).bit_length() + 6))
            table = np.zeros(1 << bits, bool)
            table[self._slot(sorted_firsts, bits)] = True
            self.classes[width] = table, bits, sorted_firsts, lengths
        self.beyond = min(FARTHEST, max((len(s) for s in found), default=0))

    @staticmethod
    def _second(length: int, width: int) -> int:
        return min(length, FARTHEST) - width

    @staticmethod
    def _hash(window: bytes, width: int) -> np.ndarray:
        return next(h for _, h in window_hashes(np.frombuffer(window, np.uint8), [width]))

    @staticmethod
    def _pair(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return first * OTHER ^ last * ODD ^ last >> np.uint64(31)

    @staticmethod
    def _slot(h: np.ndarray, bits: int) -> np.ndarray:
        return (h * ODD) >> np.uint64(64 - bits)

    def hits(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each text, whether it holds a string.  Texts lie one after another in ``data``; ``ends[0]`` is the start of the
        first, ``ends[k]`` the end of text k."""
        held = np.full(len(ends) - 1, self.any)
        if self.any or not self.classes:
            return held
        view = memoryview(data)
        for start in range(int(ends[0]), int(ends[-1]), BLOCK):
            part = data[start : min(start + BLOCK + self.beyond, int(ends[-1]))]
            for width, h in window_hashes(part, self.classes):
                table, bits, firsts, lengths = self.classes[width]
                at = np.flatnonzero(table[self._slot(h[:BLOCK], bits)])
                at = at[_among(h[at], firsts)]
                if len(at):
                    self._settle(view, ends, held, start, at, h, width, lengths)
        return held

    def _settle(self, view: memoryview, ends: np.ndarray, held: np.ndarray, start: int, at: np.ndarray, h: np.ndarray, width: int, lengths: list[tuple]) -> None:
        text = np.searchsorted(ends, at + start, "right") - 1
        for length, pairs, strings in lengths:
            left = ~held[text]  # texts that are settled are left out
            at, text = at[left], text[left]
            inside = at + start + length <= ends[text + 1]
            spot, owner = at[inside], text[inside]
            same = _among(self._pair(h[spot], h[spot + self._second(length, width)]), pairs)
            for p, k in zip((spot[same] + start).tolist(), owner[same].tolist(), strict=True):
                if not held[k] and bytes(view[p : p + length]) in strings:
                    held[k] = True


def without(frame: DataFrame, text: str, strings: list[str]) -> DataFrame:
    """The rows whose text holds none of the strings; a null holds none."""
    encoded = [s.encode() for s in strings]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(encoded)
        for batch in batches:
            texts = batch.column(text).cast(pa.large_string())
            _, where, buffer = texts.buffers()
            ends = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
            held = finder.hits(data, ends) & texts.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~held))

    return frame.mapInArrow(run, frame.schema)
