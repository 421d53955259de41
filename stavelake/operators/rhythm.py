"""Rhythm checker: do the durations of each measure add up to the meter?

One state machine serves whole documents and streams of lines: feed ``Checker`` line by line, then finish it.  Durations
are exact fractions.  The order of exceptions at a barline is fixed: pickup at the start, pickup of a section, short final
measure, a repeat's end paired with its pickup; other short measures are held back until the next barline shows that they
were not the last.  A state can be taken out and put back as JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import asdict, dataclass, field
from fractions import Fraction
from functools import lru_cache, wraps
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remembered(f: Callable[[str], Fraction | None]) -> Callable[[str], Fraction | None]:
    """``f`` with its last answers to short tokens kept."""
    kept = lru_cache(16_384)(f)
    return wraps(f)(lambda token: kept(token) if len(token) <= 64 else f(token))


@remembered
def duration(token: str) -> Fraction | None:
    """Whole notes: reciprocal or ``n%m``, dots until the first letter; 0 is a breve.  None where there is no number."""
    m = re.match(r"[\[\](){}_]*(\d+)(?:(%)(\d*))?(.*)", token, re.S)
    if not m or m[2] and not (m[3] and int(m[3])):
        return None
    dots = re.match(r"[^A-PR-Za-pr-z]*", m[4])[0].count(".")
    base = Fraction(int(m[1]), int(m[3])) if m[2] else Fraction(1, int(m[1])) if int(m[1]) else Fraction(2)
    return base * (2 ** (dots + 1) - 1) / 2**dots


@remembered
def meter(token: str) -> Fraction | None:
    m = re.fullmatch(r"\*M(\d+)/(\d+)", token)
    if not m or not int(m[1]) or not int(m[2]) or int(m[2]) & (int(m[2]) - 1):
        return None
    return Fraction(int(m[1]), int(m[2]))


@dataclass
class Spine:
    kern: bool
    next_meter: str = ""
    meter: str = ""  # of this measure
    filled: Fraction = Fraction(0)
    begun: bool = False
    measure: int = 1

    @property
    def expected(self) -> Fraction | None:
        return meter("*M" + self.meter) if self.meter else None

    @property
    def short(self) -> bool:
        return self.expected is not None and self.filled < self.expected


@dataclass
class RhythmError:
    line: int
    spine: int
    measure: int
    expected: str
    actual: str
    time_signature: str
    is_first_measure: bool = False
    is_final_measure: bool = False
    is_repeat_boundary: bool = False
    paired_pickup: str | None = None

    def __str__(self) -> str:
        pair = f" with pickup {self.paired_pickup}" if self.paired_pickup else ""
        return f"line {self.line}: spine {self.spine + 1}, measure {self.measure}: {self.actual}{pair} of {self.expected} ({self.time_signature})"


@dataclass
class Checker:
    allow_anacrusis: bool = True
    allow_incomplete_final: bool = True
    allow_repeat_pairing: bool = True
    spines: list[Spine] = field(default_factory=list)
    errors: list[RhythmError] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    held: list[RhythmError] = field(default_factory=list)
    measures: int = 0
    first: bool = True  # no barline with content yet
    pickup: list[Fraction] | None = None
    section: list[Fraction] | None = None
    awaiting: bool = False  # a section has just begun

    @property
    def kern(self) -> list[tuple[int, Spine]]:
        return [(i, s) for i, s in enumerate(self.spines) if s.kern]

    def trial(self) -> Checker:
        """A checker in the same state, to try a record on.  Errors and warnings so far do not come along: nothing reads them
        to go on, and they would make each trial as long as the text before it."""
        out = copy(self)
        out.spines, out.errors, out.warnings, out.held = [copy(s) for s in self.spines], [], [], list(self.held)
        return out

    def accept(self, line: int, text: str) -> None:
        stripped = text.strip()
        if not stripped or stripped[0] == "!":
            return
        fields, lead = text.split("\t"), stripped.split("\t")[0]
        if lead.startswith("**"):
            self.spines = [Spine(f == "**kern") for f in fields]
        elif lead == "*-":
            self._end(line)
        elif lead[0] == "*":
            self._tandem(line, fields)
        elif lead[0] == "=":
            self._bar(line, lead)
        else:
            self._data(line, fields)

    def _tandem(self, line: int, fields: list[str]) -> None:
        if not {"*^", "*v", "*x"}.isdisjoint(fields):
            try:
                self.spines = self._moved(fields)
            except ValueError as why:
                self.warnings.append(f"line {line}: {why}")
        if len(fields) == len(self.spines):
            for f, s in zip(fields, self.spines, strict=True):
                if meter(f) is not None:
                    s.next_meter = f[2:]
                    if not s.begun:
                        s.meter = f[2:]

    def _moved(self, fields: list[str]) -> list[Spine]:
        """Splits copy, merges keep the first spine with the fullest measure, exchanges swap."""
        out: list[Spine] = []
        i = 0
        left = self.spines
        for mark, run in groupby(fields):
            n = len(list(run))
            if mark == "*v":
                if i >= len(left):
                    break
                if n < 2:
                    raise ValueError("a lone *v")
                if i + n > len(left):
                    raise ValueError(f"{n} *v over {len(left) - i} spines")
                out.append(copy(left[i]))
                out[-1].filled = max(s.filled for s in left[i : i + n])
                i += n
                continue
            while n and i < len(left):
                if mark == "*x":
                    if n < 2:
                        raise ValueError("a lone *x")
                    if i + 1 >= len(left):
                        raise ValueError("*x on the last spine")
                    out += [left[i + 1], left[i]]
                    i, n = i + 2, n - 2
                    continue
                out += [left[i], copy(left[i])] if mark == "*^" else [left[i]]
                i, n = i + 1, n - 1
        return out

    def _data(self, line: int, fields: list[str]) -> None:
        for i, (f, s) in enumerate(zip(fields, self.spines, strict=False)):
            token = f.strip().split(" ")[0]
            if not s.kern or token == "." or "q" in token.lower():
                continue
            length = duration(token)
            if length is not None:
                s.filled += length
                s.begun = True
            elif token:
                self.warnings.append(f"line {line}: no duration in spine {i + 1}: {token}")

    def _error(self, line: int, i: int, s: Spine, **more) -> RhythmError:
        return RhythmError(line, i, s.measure, str(s.expected), str(s.filled), s.meter, **more)

    def _bar(self, line: int, lead: str) -> None:
        self.errors += self.held
        self.held = []
        if self.first and not any(s.filled for _, s in self.kern):
            for s in self.spines:
                s.meter, s.begun = s.next_meter, False
            return
        final = "==" in lead or "||" in lead
        ends, starts = ":|" in lead or ":!" in lead, "|:" in lead or "!:" in lead
        partner = self.section if self.section is not None else self.pickup
        for local, (i, s) in enumerate(self.kern):
            if s.expected is None or s.filled == s.expected:
                continue
            if s.short and (self.allow_anacrusis and (self.first or self.awaiting) or self.allow_incomplete_final and final):
                continue
            if s.short and ends and self.allow_repeat_pairing and partner is not None:
                before = partner[local] if local < len(partner) else Fraction(0)
                if before + s.filled != s.expected:
                    self.errors.append(self._error(line, i, s, is_final_measure=final, is_repeat_boundary=True, paired_pickup=str(before)))
                continue
            error = self._error(line, i, s, is_first_measure=self.first, is_final_measure=final, is_repeat_boundary=ends)
            (self.held if s.short and not final and self.allow_incomplete_final else self.errors).append(error)
        if self.allow_anacrusis:
            lengths = [s.filled for _, s in self.kern]
            short = any(s.short for _, s in self.kern)
            if self.first and short:
                self.pickup = lengths
            if self.awaiting:
                self.section = lengths if short else self.section
                self.awaiting = False
        if ends:
            self.section, self.awaiting = None, False
        if self.allow_anacrusis and (starts or final):
            self.awaiting = True
        if self.kern:
            self.measures = self.kern[0][1].measure
        for s in self.spines:
            s.filled, s.begun, s.meter, s.measure = Fraction(0), False, s.next_meter, s.measure + 1
        self.first = False

    def _end(self, line: int) -> None:
        if not any(s.filled for _, s in self.kern):
            self.errors += [] if self.allow_incomplete_final else self.held
            self.held = []
            return
        self.errors += self.held
        self.held = []
        for i, s in self.kern:
            if s.filled and s.expected is not None and s.filled != s.expected and not (s.short and self.allow_incomplete_final):
                self.errors.append(self._error(line, i, s, is_final_measure=True))

    def finish(self) -> dict:
        self.errors += self.held
        self.held = []
        return {"measures_checked": self.measures, "errors": self.errors, "warnings": self.warnings}

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @classmethod
    def from_json(cls, text: str) -> Checker:
        x = json.loads(text)
        x["spines"] = [Spine(**s | {"filled": Fraction(s["filled"])}) for s in x["spines"]]
        for k in ("errors", "held"):
            x[k] = [RhythmError(**e) for e in x[k]]
        for k in ("pickup", "section"):
            x[k] = x[k] and [Fraction(v) for v in x[k]]
        return cls(**x)


def check_text(text: str, **options: bool) -> dict:
    checker = Checker(**options)
    for i, line in enumerate(text.removesuffix("\n").split("\n"), 1):
        checker.accept(i, line.removesuffix("\r"))
    return checker.finish()


ERROR = "struct<line:int,spine:int,measure:int,expected:string,actual:string,time_signature:string,is_first_measure:boolean,is_final_measure:boolean,is_repeat_boundary:boolean,paired_pickup:string>"
RESULT = f"measures_checked int, errors array<{ERROR}>, warnings array<string>"


def rhythm_column(text: Column | str = "text", **options: bool) -> Column:
    """STRUCT of measures_checked, errors and warnings of each whole document."""

    @F.pandas_udf(RESULT)
    def check(texts: pd.Series) -> pd.DataFrame:
        found = [check_text(t if isinstance(t, str) else "", **options) for t in texts]
        rows = [(r["measures_checked"], [asdict(e) for e in r["errors"]], r["warnings"]) for r in found]
        return pd.DataFrame(rows, columns=["measures_checked", "errors", "warnings"])

    return check(text)


def summary(checked: DataFrame, result: str = "rhythm") -> DataFrame:
    """Totals over documents: files, ok and failed ones, measures, errors, warnings."""
    r = F.col(result)
    failed = F.size(r["errors"]) > 0
    return checked.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(~failed).alias("ok_files"),
        F.count_if(failed).alias("failed_files"),
        F.sum(r["measures_checked"]).alias("measures_checked"),
        F.sum(F.size(r["errors"])).alias("total_errors"),
        F.sum(F.size(r["warnings"])).alias("total_warnings"),
    )


def numbered_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line): the long form that the stream checker reads."""
    return docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(text, "\n\\z", ""), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def check_lines(pairs: Iterator[tuple[int, str]], **options: bool) -> dict:
    checker = Checker(**options)
    for i, line in sorted(pairs):
        checker = Checker.from_json(checker.to_json())
        checker.accept(i, line)
    return checker.finish()
