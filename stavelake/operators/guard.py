"""Runaway guard: running counters of control markers in a growing sequence, and what they no longer allow."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers by class, and caps by strictness (same marker in a row, control lines in a row, then by class).
MARKERS = {
    "spine_splits": ["*^"],
    "spine_merges": ["*v"],
    "ottava_markers": ["*8va", "*X8va", "*8ba", "*X8ba", "*15va", "*X15va", "*15ba", "*X15ba", "*15ma", "*X15ma"],
    "tuplet_markers": ["*Xtuplet", "*tuplet"],
    "tremolo_markers": ["*tremolo", "*Xtremolo"],
}
CAPS = {"lenient": (12, 10, 96, 128, 32, 24, 24), "moderate": (8, 6, 64, 96, 16, 12, 12), "strict": (5, 4, 40, 64, 10, 8, 8)}
CLASS_OF = {m: kind for kind, marks in MARKERS.items() for m in marks}
TOKEN = re.compile(r"\t|\n|[^\t\n]+")
#: Characters of an unfinished line that are kept, and of a longer one its end.
MOST_LINE, LINE_END = 4096, 1024


@dataclass
class Guard:
    """Feed tokens; ``blocked`` names the markers that may not come next."""

    strictness: str = "moderate"
    same: int = 0  # times that the last marker came in a row
    last: str | None = None
    control_lines: int = 0  # lines in a row of nothing but markers
    line: str = ""
    counts: Counter = field(default_factory=Counter)

    def __post_init__(self) -> None:
        if self.strictness not in CAPS:
            raise ValueError(f"{self.strictness!r} is none of {', '.join(CAPS)}")

    def feed(self, token: str) -> None:
        marker = token if token in CLASS_OF else None
        self.same = self.same + 1 if marker and marker == self.last else int(marker is not None)
        self.last = marker
        self.line += token
        if "\n" not in self.line and len(self.line) > MOST_LINE:
            self.line = self.line[-LINE_END:]
        *done, self.line = self.line.split("\n")
        for line in done:
            self._close(line)

    def _close(self, line: str) -> None:
        found = [f.strip() for f in line.split("\t")]
        told = [f for f in found if f and f != "*"]
        self.counts.update(CLASS_OF[f] for f in told if f in CLASS_OF)
        self.control_lines = self.control_lines + 1 if told and all(f in CLASS_OF for f in told) else 0

    def blocked(self) -> set[str]:
        same, lines, *caps = CAPS[self.strictness]
        out = {m for (kind, marks), cap in zip(MARKERS.items(), caps, strict=True) if self.counts[kind] >= cap for m in marks}
        if self.last is not None and self.same >= same:
            out.add(self.last)
        return set(CLASS_OF) if self.control_lines >= lines else out


SCHEMA = "spine_splits int, spine_merges int, ottava_markers int, tuplet_markers int, tremolo_markers int, control_lines int, blocked array<string>"


def guard_column(text: Column | str, strictness: str = "moderate") -> Column:
    """STRUCT of the counters after a whole text, and the markers that may not follow it."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            guard = Guard(strictness)
            for token in TOKEN.findall(text if isinstance(text, str) else ""):
                guard.feed(token)
            rows.append((*(guard.counts[k] for k in MARKERS), guard.control_lines, sorted(guard.blocked())))
        return pd.DataFrame(rows, columns=[*MARKERS, "control_lines", "blocked"])

    return run(text)
