"""Seeded text augmentations.  Each draws from a generator made of the sample's seed and the augmentation's name."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stavelake.operators.spines import is_bar, is_data, is_merge, is_note, is_split

# Words that are drawn from.
TEMPI = ["Largo", "Adagio", "Andante", "Moderato", "Allegro", "Presto"]
EXPRESSIONS = ["espressivo", "cantabile", "dolce", "con brio", "con moto", "con fuoco", "con anima", "leggiero", "sostenuto", "grazioso", "maestoso", "tranquillo", "agitato", "appassionato", "scherzando", "brillante"]
DYNAMICS = ["pp", "p", "mp", "mf", "f", "ff", "sf", "z"]
TRAILING = "[]()_LJKk/\\"  # marks that stay behind an inserted one
MARKS = {"staccatos": ("'", 0.08), "sforzandos": ("z", 0.05), "accents": ("^", 0.03), "fermatas": (";", 0.02)}
BPM = (40, 180)


def generator(seed: int, name: str) -> random.Random:
    return random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big"))


def _insert(token: str, mark: str) -> str:
    body = token.rstrip(TRAILING)
    return body + mark + token[len(body) :]


def _width(rows: list[str], at: int) -> int:
    """Spines where a record would be inserted: those of the next record, else of the last."""
    return next((len(r.split("\t")) for r in [*rows[at:], *reversed(rows[:at])] if r.strip() and not r.startswith("!")), 1)


def _record(token: str, width: int) -> str:
    return "\t".join([token, *["*"] * (width - 1)])


def _head(rows: list[str]) -> int:
    """The first record that is neither a comment nor a header interpretation."""
    return next((i for i, r in enumerate(rows) if r.strip() and not (r[0] in "!*" and not is_split(r) and not is_merge(r) and not r.startswith("*-"))), len(rows))


def xtuplet(text: str, rng: random.Random, p: float = 0.5) -> str:
    rows = text.split("\n")
    width = _width(rows, 0)
    with_tuplets = set()
    for r in filter(is_data, rows):
        for i, f in enumerate(r.split("\t")[:width]):
            m = re.match(r"\d+", f)
            if m and (int(m[0]) & (int(m[0]) - 1) or not int(m[0])):
                with_tuplets.add(i)
    marks = ["*Xtuplet" if i in with_tuplets and rng.random() < p else "*" for i in range(width)]
    if "*Xtuplet" in marks:
        rows.insert(_head(rows), "\t".join(marks))
    return "\n".join(rows)


def invisible_rests(text: str, rng: random.Random, p: float = 0.5) -> str:
    """Rests between a split and the next merge, unless all spines rest."""
    out, inside = [], False
    for r in text.split("\n"):
        if is_split(r) or is_merge(r):
            inside = is_split(r)
        elif inside and is_data(r):
            found = r.split("\t")
            if not all("r" in f.lower() for f in found):
                r = "\t".join(_insert(f, "yy") if "r" in f.lower() and rng.random() < p else f for f in found)
        out.append(r)
    return "\n".join(out)


def drop_first_meter(text: str, rng: random.Random) -> str:
    rows = text.split("\n")
    for i, r in enumerate(rows):
        if not r.startswith("*"):
            break
        if any(re.fullmatch(r"\*M\d+/\d+", f) for f in r.split("\t")) and all(f == "*" or re.fullmatch(r"\*M\d+/\d+", f) for f in r.split("\t")):
            del rows[i]
            break
    return "\n".join(rows)


def key_signature(token: str) -> dict[str, str] | None:
    m = re.fullmatch(r"\*k\[((?:[a-gA-G](?:##?|--?))*)\]", token)
    return m and {a[0].lower(): a[1] for a in re.findall(r"([a-gA-G])(##?|--?)", m[1])}


def courtesy_naturals(text: str, rng: random.Random, p: float = 0.35) -> str:
    """A natural where key and measure already make the note natural; chords make a spine unsure until the barline, and
    texts with splits or merges stay."""
    rows = text.split("\n")
    if any(is_split(r) or is_merge(r) for r in rows):
        return text
    keys: dict[int, dict[str, str]] = {}
    measure: dict[int, dict[str, str]] = {}
    unsure: set[int] = set()
    for n, r in enumerate(rows):
        found = r.split("\t")
        if not r or r[0] == "!":
            continue
        if is_bar(r):
            measure, unsure = {}, set()
            continue
        for i, f in enumerate(found):
            if r[0] == "*":
                if (k := key_signature(f)) is not None:
                    keys[i], measure[i] = k, {}
                    unsure.discard(i)
                continue
            if i in unsure or f in ("", "."):
                continue
            if " " in f:
                if any(map(is_note, f.split(" "))):
                    unsure.add(i)
                continue
            if not is_note(f) or "r" in f.lower() or "q" in f:
                continue
            m = re.match(r"[\[\]()]*[\d.]*([A-Ga-g]+)([#n-]*)", f)
            if not m or m[2] not in ("", "#", "##", "-", "--", "n"):
                unsure.add(i)
                continue
            now = measure.setdefault(i, {}).get(m[1], keys.get(i, {}).get(m[1][0].lower(), ""))
            if not m[2] and not now and rng.random() < p:
                found[i] = _insert(f, "n")
            if m[2]:
                measure[i][m[1]] = m[2]
        rows[n] = "\t".join(found)
    return "\n".join(rows)


def articulate(mark: str, p: float) -> Callable[[str, random.Random], str]:
    """A mark on notes drawn one by one."""

    def apply(text: str, rng: random.Random) -> str:
        return "\n".join("\t".join(" ".join(_insert(t, mark) if is_note(t) and rng.random() < p else t for t in f.split(" ")) for f in r.split("\t")) if is_data(r) else r for r in text.split("\n"))

    return apply


def pedals(text: str, rng: random.Random, p: float = 0.3) -> str:
    rows = text.split("\n")
    bars = [i for i, r in enumerate(rows) if r and is_bar(r)]
    for a, b in [x for x in zip(bars, bars[1:], strict=False) if rng.random() < p][::-1]:
        rows.insert(b, _record("*Xped", _width(rows, b)))
        rows.insert(a + 1, _record("*ped", _width(rows, a + 1)))
    return "\n".join(rows)


def tempo(text: str, rng: random.Random, with_number: float = 0.35) -> str:
    if re.search(r"(?m)^!!!OMD:|(?:^|\t)\*MM", text):
        return text
    rows = text.split("\n")
    if rng.random() < with_number:
        at = _head(rows)
        rows.insert(at, _record(f"*MM{rng.randint(*BPM)}", _width(rows, at)))
    first = next((i for i, r in enumerate(rows) if r.strip() and not r.startswith("!")), 0)
    rows.insert(first, f"!!!OMD: {rng.choice(TEMPI)}")
    return "\n".join(rows)


def expression(text: str, rng: random.Random) -> str:
    rows = text.split("\n")
    bars = [i for i, r in enumerate(rows) if r and is_bar(r)]
    at = rng.choice(bars) + 1 if bars else _head(rows)
    rows.insert(at, _record(f"*>{rng.choice(EXPRESSIONS)}", _width(rows, at)))
    return "\n".join(rows)


def instrument_label(text: str, rng: random.Random) -> str:
    if re.search(r"(?m)(?:^|\t)\*I", text):
        return text
    rows = text.split("\n")
    first = next((i for i, r in enumerate(rows) if r.strip()), 0)
    rows.insert(first + rows[first].startswith("**"), "\t".join(['*I"Piano'] * _width(rows, first)))
    return "\n".join(rows)


def _dynamics_spine(rows: list[str], marks: dict[int, str]) -> str:
    """A last spine ``**dynam`` with the marks at their records."""

    def token(i: int, r: str) -> str | None:
        if not r or r.startswith("!"):
            return None
        if r.startswith("**"):
            return "**dynam"
        return "*-" if r.startswith("*-") else "*" if r[0] == "*" else r.split("\t")[0] if r[0] == "=" else marks.get(i, ".")

    return "\n".join(r if (t := token(i, r)) is None else f"{r}\t{t}" for i, r in enumerate(rows))


def non_overlapping_spans(steps: int, most: int, rng: random.Random, longest: int = 8) -> list[tuple[int, int]]:
    """Up to ``most`` spans of at least two steps, apart from one another."""
    free, out = [(0, steps - 1)], []
    for _ in range(rng.randint(1, max(1, min(most, steps // 2))) if steps >= 2 else 0):
        room = [r for r in free if r[1] > r[0]]
        if not room:
            break
        a, b = rng.choice(room)
        n = rng.randint(2, min(longest, b - a + 1))
        begin = rng.randint(a, b - n + 1)
        out.append((begin, begin + n - 1))
        free = [r for r in free if r != (a, b)] + [(a, begin - 1), (begin + n, b)]
    return sorted(out)


def hairpins(text: str, rng: random.Random, most: int = 2) -> str:
    rows = text.split("\n")
    steps = [i for i, r in enumerate(rows) if is_data(r)]
    marks: dict[int, str] = {}
    for a, b in non_overlapping_spans(len(steps), most, rng):
        start, inside, end = "<([" if rng.random() < 0.5 else ">)]"
        marks |= {steps[k]: inside for k in range(a + 1, b)} | {steps[a]: start, steps[b]: end}
    return _dynamics_spine(rows, marks) if marks else text


def dynamics(text: str, rng: random.Random, least: int = 1, most: int = 2) -> str:
    rows = text.split("\n")
    steps = [i for i, r in enumerate(rows) if is_data(r)]
    chosen = rng.sample(steps, min(rng.randint(least, most), len(steps)))
    return _dynamics_spine(rows, {i: rng.choice(DYNAMICS) for i in chosen}) if chosen else text


ENABLED = ["xtuplet", "invisible_rests", "drop_first_meter", "courtesy_naturals"]
REGISTRY: dict[str, Callable[[str, random.Random], str]] = {
    f.__name__: f for f in (xtuplet, invisible_rests, drop_first_meter, courtesy_naturals, pedals, tempo, expression, instrument_label, hairpins, dynamics)
} | {name: articulate(mark, p) for name, (mark, p) in MARKS.items()}


def augment(text: str, seed: int, names: list[str] = ENABLED) -> str:
    for name in names:
        if name not in REGISTRY:
            raise ValueError(f"Unknown augmentation {name!r}. Available: {', '.join(sorted(REGISTRY))}")
        text = REGISTRY[name](text, generator(seed, name)) if text else text
    return text


def augment_column(text: Column | str, seed: Column | str, names: list[str] = ENABLED) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([augment(t, int(s), names) if isinstance(t, str) else None for t, s in zip(texts, seeds, strict=True)], dtype=object)

    return run(text, seed)
