"""Spine algebra: widths, masks and lineage of a kern document, record by record."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import groupby
from typing import Any


class SpineError(ValueError):
    """A record whose width or spine operations cannot be."""


class UnsupportedSpineOperation(SpineError):
    """An exchange or an added spine."""


def is_interpretation(fields: Sequence[str]) -> bool:
    return bool(fields) and all(f.startswith("*") for f in fields)


def is_bar(record: str) -> bool:
    return all(f.startswith("=") for f in record.split("\t"))


def is_terminator(record: str) -> bool:
    return all(f == "*-" for f in record.split("\t"))


def _only(record: str, mark: str) -> bool:
    found = set(record.split("\t"))
    return mark in found and found <= {mark, "*"}


def is_split(record: str) -> bool:
    return _only(record, "*^")


def is_merge(record: str) -> bool:
    return _only(record, "*v")


def is_data(record: str) -> bool:
    return bool(record) and record[0] not in "!*="


def is_note(token: str) -> bool:
    return bool(token) and token[0] not in "*!" and not set("abcdefgABCDEFG").isdisjoint(token)


def merge_runs(fields: Sequence[str]) -> Iterable[tuple[str, list[int]]]:
    """(mark, places): adjacent ``*v`` together, all others alone."""
    for mark, run in groupby(enumerate(fields), key=lambda x: "*v" if x[1] == "*v" else x[0]):
        places = [i for i, _ in run]
        yield (mark if mark == "*v" else fields[places[0]]), places


def advance(state: Sequence[Any], fields: Sequence[str], merge: Callable[[list], Any] = lambda found: found[0]) -> list:
    """The state of each spine after a record: splits copy it, merges combine it, ends drop it.

    Records that are not interpretations leave it as it is.  Raises for a width that differs, for ``*x`` and ``*+``, and for
    a ``*v`` without a neighbour.
    """
    if not is_interpretation(fields):
        return list(state)
    if len(fields) != len(state):
        raise SpineError(f"interpretation over {len(fields)} spines where {len(state)} are open")
    odd = sorted({"*x", "*+"}.intersection(fields))
    if odd:
        raise UnsupportedSpineOperation(f"no support for {', '.join(odd)}")
    out: list = []
    for mark, places in merge_runs(fields):
        if mark == "*v":
            if len(places) < 2:
                raise SpineError(f"a lone '*v' in spine {places[0] + 1} has nothing to merge with")
            out.append(merge([state[i] for i in places]))
        elif mark != "*-":
            out += [state[places[0]]] * (2 if mark == "*^" else 1)
    return out


def significant(text: str) -> list[tuple[int, str]]:
    """(place, record) without blank lines and global comments; all line ends are line feeds."""
    return [(i, r) for i, r in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")) if r.strip() and not r.strip().startswith("!!")]


Lineage = list[tuple[int, ...]]


def lineage(text: str) -> tuple[Lineage, Lineage]:
    """The roots of each spine, first and before the terminators.  Raises SpineError with the line."""
    now: Lineage | None = None
    first: Lineage = []
    last: Lineage = []
    for i, record in significant(text):
        fields = record.split("\t")
        if now is None:
            now = first = last = [(k,) for k in range(len(fields))]
        if len(fields) != len(now):
            raise SpineError(f"line {i + 1}: {len(fields)} fields where {len(now)} spines are open")
        try:
            now = advance(now, fields, merge=lambda found: tuple(dict.fromkeys(r for roots in found for r in roots)))
        except SpineError as why:
            raise SpineError(f"line {i + 1}: {why}") from why
        if not (is_interpretation(fields) and is_terminator(record)):
            last = now
    if now is None:
        raise SpineError("nothing but blanks and comments")
    return first, last


def widths(text: str) -> tuple[int | None, int | None, str | None]:
    """(first width, last width, error): widths are null where the structure is broken."""
    try:
        first, last = lineage(text)
    except SpineError as why:
        return None, None, str(why)
    return len(first), len(last), None


def restore_width(text: str) -> str:
    """Merge records before the final barline until the spines are those of the start.

    Only spines with the same first root merge, in rounds that leave out runs that touch one already chosen; barline and
    terminators shrink with them.  Where that cannot reach the first width the text stays.
    """
    try:
        first, last = lineage(text)
    except SpineError:
        return text
    if len(first) >= len(last):
        return text
    rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    tail = [i for i, _ in significant(text)]
    ends = []
    while tail and is_terminator(rows[tail[-1]]):
        ends.insert(0, tail.pop())
    if not tail or not is_bar(rows[tail[-1]]) or any(len(rows[i].split("\t")) != len(last) for i in (tail[-1], *ends)):
        return text

    def same_root(spines: Lineage) -> list[list[int]]:
        return [list(g) for _, g in groupby(range(len(spines)), key=lambda i: spines[i][0])]

    for i in (tail[-1], *ends):
        found = rows[i].split("\t")
        rows[i] = "\t".join(found[run[0]] for run in same_root(last))
    merges, goal = [], [s[0] for s in first]
    while [s[0] for s in last] != goal:
        chosen: list[list[int]] = []
        for run in same_root(last):
            if len(run) > 1 and not (chosen and run[0] == chosen[-1][-1] + 1):
                chosen.append(run)
        if not chosen:
            return text
        marked = {i for run in chosen for i in run}
        merges.append("\t".join("*v" if i in marked else "*" for i in range(len(last))))
        gone = {i for run in chosen for i in run[1:]}
        last = [s for i, s in enumerate(last) if i not in gone]
    rows[tail[-1] : tail[-1]] = merges
    return "\n".join(rows)
