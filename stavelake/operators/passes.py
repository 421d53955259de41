"""Normalisation passes.  Stateless ones are Column expressions, ordered state machines are functions of one text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from fractions import Fraction
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from stavelake.functions import kern as K
from stavelake.operators.spines import SpineError, advance, is_bar, is_data, is_interpretation, is_merge, is_note, is_split, is_terminator, merge_runs

Stats = Counter

# --- expressions -----------------------------------------------------------------------------------------------

# Fields that become null interpretations.
UNWANTED = "*cue *Xcue *kcancel *below *ped *Xped *tuplet *Xtuplet *Alternative".split()
UNWANTED_FIELDS = [
    r"\*[a-gA-G][#-]?:",  # analysed key
    r"\*I[^\t\n]*",  # instrument
    r"\*MM\d+(?:\.\d+)?",  # tempo
    r"\*Trd-?\d+c-?\d+",  # transposition
    r"\*part\d+",
    r"\*staff\d+",
]
BARLINES = {"=|!": "=", "==:|!": "=:|!"}
ACCIDENTALS = [("##n", "n"), ("--n", "n"), ("#n", "n"), ("-n", "n"), ("#-", "-"), ("-#", "#")]
MOST_SLURS = 2
HEADER_ORDER = {
    "stria": r"\*stria\d+",
    "staff": r"\*staff\d+",
    "clef": r"\*clef[A-Ga-gvX]v?\d?",
    "key": r"\*k\[.*\]",
    "meter": r"\*M\d+/\d+|\*met\(.+\)",
    "xtuplet": r"\*Xtuplet",
}
FINAL_BARLINES, START_REPEATS = ["=||", "="], ["=!|:", "=:|!|:", "=:!|:"]


def cleanup_kern(c: Column) -> Column:
    """Comments, unwanted interpretations and marks, bar numbers and the header line go."""
    sub = F.regexp_replace
    c = sub(c, r"(?dm)^!.*(?:\r?\n|$)", "")
    c = sub(c, r"(?dm)(^|[ \t])(?:" + "|".join(re.escape(t) for t in UNWANTED) + r")(?=[ \t]|$)", "$1*")
    for found in UNWANTED_FIELDS:
        c = sub(c, rf"(?dm)(^|\t){found}(?=\t|$)", "$1*")
    c = sub(c, r"(?dm)^[ \t]*\*(?:[ \t]+\*)*[ \t]*(?:\r?\n|$)", "")
    c = sub(c, r"(?<!clef)(?<!\*)X", "")
    c = sub(c, r"@+[^@]+@+", "")
    data = lambda rewrite: lambda f: F.when(f.rlike("^[*=]"), f).otherwise(rewrite(f))
    c = K.map_fields(c, data(lambda f: F.array_join(F.transform(K.tokens(f), lambda t: F.regexp_replace(F.translate(t, "S$&p", ""), "([LJKk]+)s$", "$1")), " ")))
    c = F.translate(c, "<>yjRZ", "")
    c = sub(c, r"(?<==)\d+", "")
    c = K.map_fields(c, data(lambda f: F.translate(f, "N/\\'^~", "")))
    c = sub(c, r"(?dm)^(?:[^\t\n]*\t)*\*\*e?kern(?:_[^\t\n]+)?(?:\t[^\t\n]*)*(?:\r?\n|$)", "")
    return sub(c, r"^\s+|\s+$", "")


def strip_terminal_terminator(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\n+$", ""), r"(?:(?:^|\n)\*-(?:\t\*-)*)+$", "")


def remove_grace_rests(c: Column) -> Column:
    return K.map_tokens(c, lambda t: F.when(t.rlike(r"^\d*\.*q+r"), ".").otherwise(t))


def remove_leading_barlines(c: Column) -> Column:
    def cut(rs: Column) -> Column:
        first = F.array_min(F.transform(rs, lambda r, i: F.when(K.is_data_record(r), i)))
        return K.let(first, lambda k: F.array_join(F.filter(rs, lambda r, i: k.isNull() | (i >= k) | ~K.is_bar_record(r)), "\n"))

    return K.let(K.records(c), cut)


def leading_barlines_error(c: Column) -> Column:
    """A text with barlines but no data cannot be right."""
    rs = K.records(c)
    return F.when(F.exists(rs, K.is_bar_record) & ~F.exists(rs, K.is_data_record), "barlines but no data")


def remove_null_lines(c: Column) -> Column:
    return K.keep_records(c, lambda r: ~r.rlike(r"^\.(\t\.)*$"))


def canonicalize_barlines(c: Column) -> Column:
    def field(f: Column) -> Column:
        out = f
        for old, new in BARLINES.items():
            out = F.when(f == old, new).otherwise(out)
        return out

    row = lambda r: F.when(K.is_bar_record(r), F.array_join(F.transform(K.fields(r), field), "\t")).otherwise(r)
    return F.when(c == "", c).otherwise(K.map_records(c, row, K.lines))


def cap_slurs(c: Column) -> Column:
    count = lambda t, mark: F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))

    def token(t: Column) -> Column:
        opens, closes = count(t, "("), count(t, ")")
        keep = lambda mark, n: F.repeat(F.lit(mark), F.least(n, F.lit(MOST_SLURS)).cast("int"))
        return F.when((opens <= MOST_SLURS) & (closes <= MOST_SLURS), t).otherwise(F.concat(keep("(", opens), F.translate(t, "()", ""), keep(")", closes)))

    return K.map_notes(c, token)


def header_type(record: Column) -> Column:
    """Rank of the one header type of a record whose other fields are null interpretations; null for other records."""
    out = F.lit(None).cast("int")
    for rank, found in enumerate(HEADER_ORDER.values()):
        own = rf"(?:{found.replace('.*', '[^\\t]*').replace('.+', '[^\\t]+')})"
        out = F.when(record.rlike(rf"^(?:\*|{own})(?:\t(?:\*|{own}))*$") & record.rlike(rf"(?:^|\t){own}(?:\t|$)"), rank).otherwise(out)
    return out


def canonicalize_header_order(c: Column) -> Column:
    """The first block of header records, sorted by type and kept in order within one."""

    def typed(rs: Column) -> Column:
        return F.transform(rs, lambda r, i: F.struct(header_type(r).alias("k"), i.alias("i"), r.alias("r")))

    def block(xs: Column) -> Column:
        begin = F.array_min(F.transform(xs, lambda x: F.when(x["k"].isNotNull(), x["i"])))
        end = lambda at: F.coalesce(F.array_min(F.transform(xs, lambda x: F.when((x["i"] > at) & x["k"].isNull(), x["i"]))), F.size(xs))
        return K.let(begin, lambda at: K.let(F.struct(at.alias("a"), end(at).alias("b")), lambda s: ordered(xs, s["a"], s["b"])))

    def ordered(xs: Column, a: Column, b: Column) -> Column:
        whole = F.concat(F.slice(xs, F.lit(1), a), F.array_sort(F.slice(xs, a + 1, b - a)), F.slice(xs, b + 1, F.size(xs)))
        return F.array_join(F.transform(F.when(a.isNull(), xs).otherwise(whole), lambda x: x["r"]), "\n")

    return K.let(typed(K.records(c)), block)


def normalize_null_keysig(c: Column) -> Column:
    def row(r: Column) -> Column:
        explicit = F.array_join(F.transform(K.fields(r), lambda f: F.when(f == "*", "*k[]").otherwise(f)), "\t")
        return F.when(r.rlike(r"(?:^|\t)\*k\[[^\t]*\](?:\t|$)"), explicit).otherwise(r)

    return K.map_records(c, row)


def remove_contradictory_accidentals(c: Column) -> Column:
    def token(t: Column) -> Column:
        for old, new in ACCIDENTALS:
            t = F.replace(t, F.lit(old), F.lit(new))
        return t

    return K.map_notes(c, token)


def remove_conflicting_bowings(c: Column) -> Column:
    return K.map_notes(c, lambda t: F.when(t.contains("v") & t.contains("u"), F.translate(t, "u", "")).otherwise(t))


def remove_null_ties(c: Column) -> Column:
    def token(t: Column) -> Column:
        for mark in (r"\[", r"\]", "_"):
            t = F.regexp_replace(t, mark + "{2,}", mark.strip("\\"))
        for gone in ("[[]]", "[]", "(())", "()"):
            t = F.replace(t, F.lit(gone), F.lit(""))
        return t

    return K.map_notes(c, token)


def normalize_final_barline(c: Column) -> Column:
    def row(r: Column) -> Column:
        fs = K.fields(r)
        plain = F.forall(fs, lambda f: f.isin(FINAL_BARLINES))
        return F.array_join(F.transform(fs, lambda f: F.when(plain, "==").when(f.isin(START_REPEATS), "=:|!").otherwise(f)), "\t")

    def rewrite(rs: Column) -> Column:
        last = F.array_max(F.transform(rs, lambda r, i: F.when(K.is_bar_record(r), i)))
        return K.let(last, lambda k: F.when(k.isNull(), c).otherwise(F.array_join(F.transform(rs, lambda r, i: F.when(i == k, row(r)).otherwise(r)), "\n")))

    return F.when(c == "", c).otherwise(K.let(K.lines(c), rewrite))


# --- state machines --------------------------------------------------------------------------------------------


def _rows(text: str) -> list[list[str]]:
    return [r.split("\t") for r in text.split("\n")]


def _join(rows: list[list[str]]) -> str:
    return "\n".join("\t".join(r) for r in rows)


def _notes(text: str, rewrite: Callable[[str], str]) -> str:
    """Rewrites note tokens in reading order."""
    return "\n".join("\t".join(" ".join(rewrite(t) if is_note(t) else t for t in f.split(" ")) for f in r.split("\t")) for r in text.splitlines())


_ALL_STARS = re.compile(r"(?m)^\*(?:\t\*)*(?:\r?\n|$)")
_KERN = re.compile(r"\*\*e?kern(?:_[^\t\n]+)?")


def remove_non_kern_spines(text: str, stats: Stats) -> str:
    """Keeps kern columns from the first exclusive record on; records of another width pass."""
    rows = text.split("\n")
    head = next((r.split("\t") for r in rows if r and all(re.fullmatch(r"\*\*[^\t]+", f) for f in r.split("\t"))), None)
    mask = [bool(_KERN.fullmatch(f)) for f in head or []]
    if all(mask):
        return text
    out = []
    for r in rows:
        found = r.split("\t")
        if not r or r.startswith("!") or len(found) != len(mask):
            out.append(r)
            continue
        out.append("\t".join(f for f, keep in zip(found, mask, strict=True) if keep))
        try:
            mask = advance(mask, found, merge=any)
        except SpineError as why:
            raise SpineError(f"spines cannot be told apart: {why}") from why
    return "\n".join(out)


# Durations that may be written as reciprocals.
RECIPROCALS = {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 18, 20, 22, 24, 25, 26, 28, 30, 32, 34, 36, 38, 40, 44, 48, 52, 56, 60, 64, 70, 72, 80, 88, 96, 108, 112, 116, 128, 144, 160, 176, 192, 256, 272, 512, 1024}
LONG_NOTES = {2: "0", 4: "00", 8: "000"}
_DURATION = re.compile(r"([\[\](){}_&]*)(\d+)(%(\d*))?(\.*)")


def _scaled(token: str, scale: Fraction, line: int) -> str:
    found = _DURATION.match(token)
    if scale == 1 or not found or token[0] in "=*!" or "q" in token.lower():
        return token
    wrap, whole, rational, below, dots = found.groups()
    if rational:
        if not below or not int(below):
            raise ValueError(f"line {line}: no denominator in {token!r}")
        base = Fraction(int(whole), int(below))
    else:
        base = Fraction(2 ** len(whole)) if not int(whole) else Fraction(1, int(whole))
    base *= scale
    if base in LONG_NOTES:
        text = LONG_NOTES[int(base)]
    elif base.numerator == 1 and base.denominator in RECIPROCALS:
        text = str(base.denominator)
    else:
        raise ValueError(f"line {line}: {base} whole notes have no reciprocal")
    return wrap + text + dots + token[found.end() :]


def normalize_rscale(text: str, stats: Stats) -> str:
    """Writes scaled durations out.  It rejects any record off the tracked width, and drops records of null
    interpretations, also where nothing is scaled."""
    if not text:
        return text
    out, scales = [], None
    for line, r in enumerate(text.split("\n"), 1):
        if not r:
            out.append(r)
            continue
        found = r.split("\t")
        scales = scales if scales is not None else [Fraction(1)] * len(found)
        if len(found) != len(scales):
            raise ValueError(f"line {line}: {len(found)} fields where {len(scales)} spines are open")
        if not is_interpretation(found):
            out.append("\t".join(f if f == "" or f[0] in "=*!" else " ".join(_scaled(t, s, line) if t else t for t in f.split(" ")) for f, s in zip(found, scales, strict=True)))
            continue
        shown = list(found)
        for i, f in enumerate(found):
            if m := re.fullmatch(r"\*rscale:(\d+)(?:/(\d+))?", f):
                if m[2] and not int(m[2]):
                    raise ValueError(f"line {line}: zero denominator in {f!r}")
                scales[i] = Fraction(int(m[1]), int(m[2] or 1))
                if scales[i] not in (2, 1, Fraction(1, 2)):
                    raise ValueError(f"line {line}: scale {f!r} is not 2, 1 or 1/2")
                shown[i] = "*"

        def one(group: list[Fraction], line: int = line) -> Fraction:
            if len(set(group)) > 1:
                raise ValueError(f"line {line}: merged spines have scales {', '.join(map(str, sorted(set(group))))}")
            return group[0]

        try:
            scales = advance(scales, found, merge=one)
        except SpineError as why:
            raise type(why)(f"Line {line}: {why}") from why
        if set(shown) != {"*"}:
            out.append("\t".join(shown))
    return "\n".join(out)


def remove_redundant_stria(text: str, stats: Stats) -> str:
    rows = text.split("\n")
    is_stria = lambda f: bool(re.fullmatch(r"\*stria\d+", f))
    pure = lambda fs: any(map(is_stria, fs)) and all(is_stria(f) or f == "*" for f in fs)
    head = next((i for i, r in enumerate(rows) if r and r[0] not in "*!"), len(rows))
    known = next(([f if is_stria(f) else None for f in r.split("\t")] for r in rows[:head] if r and pure(r.split("\t"))), None)
    if not known:
        return text
    for i in range(head, len(rows)):
        found = rows[i].split("\t")
        if not rows[i] or not pure(found):
            continue
        changed = {j for j, f in enumerate(found[: len(known)]) if f != "*" and f != known[j]}
        if len(found) > len(known) and all(j < len(known) for j in changed):
            known = [found[j] if j in changed else k for j, k in enumerate(known)]
        elif changed:
            known = [found[j] if j in changed else k for j, k in enumerate(known)]
        else:
            rows[i] = "\t".join("*" for _ in found)
    return _ALL_STARS.sub("", "\n".join(rows))


def _after_merges(record: str) -> int:
    return sum(1 for _ in merge_runs(record.split("\t")))


def merge_split_normalizer(text: str, stats: Stats) -> str:
    """Merge, barline, split back to the old width becomes a barline of the old width; likewise before terminators."""
    out: list[str] = []
    merges: list[str] = []  # waiting merge records
    bar: str | None = None  # a barline after them
    before = after = 0  # widths around the merges

    def give_up() -> None:
        out.extend(merges)
        if bar is not None:
            out.append("\t".join([bar] * after))

    for r in text.split("\n"):
        found = r.split("\t")
        if merges and bar is None:
            if is_merge(r):
                merges.append(r)
                after = _after_merges(r)
                continue
            if is_bar(r):
                bar = found[0]
                continue
            if is_terminator(r):
                out.append("\t".join(["*-"] * before))
            else:
                out += [*merges, r]
            merges = []
            continue
        if merges:
            wide = "\t".join([bar] * before)
            if is_split(r) and sum(1 + (f == "*^") for f in found) == before:
                out.append(wide)
                merges, bar = [], None
                continue
            if is_terminator(r):
                out += [wide, "\t".join(["*-"] * before)]
                merges, bar = [], None
                continue
            give_up()
            merges, bar = [], None
            if is_merge(r):
                merges, before, after = [r], after, _after_merges(r)
                continue
            out.append(r)
            continue
        if is_merge(r):
            merges, before, after = [r], len(found), _after_merges(r)
        else:
            out.append(r)
    if merges:
        give_up()
    return "\n".join(out)


def canonicalize_spine_splits(text: str, stats: Stats) -> str:
    """Folds a split record into the one before it where it splits only spines that that one left whole."""
    out: list[str] = []
    for r in text.split("\n"):
        if out and is_split(out[-1]) and is_split(r):
            marks = [f == "*^" for f in out[-1].split("\t")]
            owner = [i for i, m in enumerate(marks) for _ in range(1 + m)]
            found = r.split("\t")
            hits = [owner[k] for k, f in enumerate(found) if f == "*^"] if len(found) == len(owner) else None
            if hits is not None and not any(marks[i] for i in hits):
                out[-1] = "\t".join("*^" if m or i in hits else "*" for i, m in enumerate(marks))
                continue
        out.append(r)
    return "\n".join(out)


def _rest_for(field: str) -> str | None:
    """An invisible rest as long as the field's one duration."""
    if field in ("", "."):
        return None
    found = [re.match(r"[\[\](){}_&]*(\d+(?:%\d+)?\.*)", t) for t in field.split(" ")]
    lengths = {m[1] if m else None for m in found}
    return None if len(lengths) != 1 or None in lengths else f"{lengths.pop()}ryy"


def _hoisted(rows: list[str], width: int) -> list[str] | None:
    splits: list[tuple[int, list[str]]] = []
    moved = False  # an interpretation came before or between the splits
    for i, r in enumerate(rows):
        found = r.split("\t")
        if is_split(r):
            if moved or len(found) != width:
                return None
            splits.append((i, found))
            width = sum(1 + (f == "*^") for f in found)
        elif is_data(r):
            if len(found) != width:
                return None
        else:
            if is_interpretation(found):
                try:
                    width = len(advance([0] * width, found))
                except SpineError:
                    return None
            moved = True
    if not splits:
        return None
    out = ["\t".join(found) for _, found in splits]
    for i, r in enumerate(rows):
        if any(i == k for k, _ in splits):
            continue
        found = r.split("\t")
        if is_data(r):
            for k, marks in splits:
                if k > i:
                    wide = []
                    for f, m in zip(found, marks, strict=True):
                        wide.append(f)
                        if m == "*^":
                            rest = _rest_for(f)
                            if rest is None:
                                return None
                            wide.append(rest)
                    found = wide
        out.append("\t".join(found))
    return out


def hoist_spine_splits_to_barline(text: str, stats: Stats) -> str:
    """Moves a measure's splits to its start and fills the new spines with invisible rests, or leaves it alone."""
    out: list[str] = []
    width = None
    for bar, group in groupby(text.split("\n"), key=is_bar):
        rows = list(group)
        if bar:
            width = len(rows[-1].split("\t"))
            out += rows
        else:
            out += (None if width is None else _hoisted(rows, width)) or rows
    return "\n".join(out)


def delay_spine_merges_to_barline(text: str, stats: Stats) -> str:
    """Moves a merge to just before the next barline and fills the merged spines with invisible rests, or leaves it."""
    out: list[str] = []
    merge: str | None = None
    narrow: list[str] = []
    wide: list[str] = []
    runs: list[list[int]] = []
    for r in text.split("\n"):
        if merge is None:
            if is_merge(r):
                merge, narrow, wide = r, [], []
                runs = [places for _, places in merge_runs(r.split("\t"))]
            else:
                out.append(r)
            continue
        found = r.split("\t")
        if is_bar(r) and len(found) == len(runs):
            out += [*wide, merge, r]
            merge = None
            continue
        spread = None
        if is_data(r) and len(found) == len(runs):
            spread = [x for f, places in zip(found, runs, strict=True) for x in [f, *[_rest_for(f)] * (len(places) - 1)]]
        if spread is None or None in spread:
            out += [merge, *narrow, r]
            merge = None
            continue
        narrow.append(r)
        wide.append("\t".join(spread))
    if merge is not None:
        out += [merge, *narrow]
    return "\n".join(out)


# Mensuration signs and the meters they stand for.
MENSURATION = {"*met(c)": "*M4/4", "*met(C)": "*M4/4", "*met(c|)": "*M2/2", "*met(C|)": "*M2/2"}


def remove_redundant_time_signatures(text: str, stats: Stats) -> str:
    """A meter record beside an equivalent mensuration record, before or after it, goes."""
    rows = _rows(text)
    signs: list[str] | None = None  # the pending mensuration record
    meter: int | None = None  # the meter record just before

    def meant(meters: list[str], marks: list[str]) -> bool:
        return len(meters) == len(marks) and all(m == "*" or m == MENSURATION.get(s) for m, s in zip(meters, marks, strict=True))

    for i, found in enumerate(rows):
        if found == [""]:
            meter = None
            continue
        if found[0][:1] not in ("*", "!") or any(re.fullmatch(r"\*[\^vx+\-]", f) for f in found):
            signs = meter = None
            continue
        if any(f in MENSURATION for f in found) and all(f in MENSURATION or f == "*" for f in found):
            if meter is not None and meant(rows[meter], found):
                rows[meter] = ["*"] * len(rows[meter])
            signs, meter = found, None
            continue
        is_meter = lambda f: bool(re.fullmatch(r"\*M\d+/\d+", f))
        if any(map(is_meter, found)) and all(is_meter(f) or f == "*" for f in found):
            if signs and meant(found, signs):
                rows[i] = ["*"] * len(found)
                signs = None
            else:
                meter = i
        else:
            meter = None
    return _ALL_STARS.sub("", _join(rows))


_CLEF = re.compile(r"\*clef[A-Ga-gvX]v?\d?")


def merge_header_clef_lines(text: str, stats: Stats) -> str:
    """Adjacent clef records of the header become one with each spine's last clef."""
    rows = text.split("\n")
    end = next((i for i, r in enumerate(rows) if r and r.split("\t")[0][:1] not in ("*", "!")), len(rows))
    is_clef = lambda r: r.startswith("*") and any(map(_CLEF.fullmatch, r.split("\t"))) and all(f == "*" or _CLEF.fullmatch(f) for f in r.split("\t"))
    out: list[str] = []
    for clef, group in groupby(rows[:end], key=is_clef):
        found = [r.split("\t") for r in group]
        if clef and len(found) > 1:
            same = len({len(f) for f in found}) == 1
            found = [[next((f for f in reversed(spine) if f != "*"), "*") for spine in zip(*found, strict=True)]] if same else found[:1]
        out += ["\t".join(f) for f in found]
    return "\n".join(out + rows[end:])


# Marks of a note by slot; a slot's marks stand together in the order of SLOTS.
SLOTS = "accidental pause ornament harmonic articulation arpeggio slur breath tie beam editorial".split()
MARKS = {"accidental": "#-n", "pause": ";", "ornament": "TtMmWwS$RO", "harmonic": "o", "articulation": "'`~^iIvu", "arpeggio": ":", "slur": "()", "breath": ",", "tie": "[]_", "beam": "LJKk", "editorial": "yx"}
SLOT_OF = {mark: slot for slot, marks in MARKS.items() for mark in marks}
PITCHES = "abcdefgABCDEFG"


def _canonical(token: str, stats: Stats) -> str:
    if not token or token == "." or token[0] in "=*!" or not re.search("[a-gA-Gr]", token):
        return token
    slots = dict.fromkeys(SLOTS, "")
    if m := re.search(r"(\d+(?:%\d+)?\.*)qq([a-gA-G]+)", token):  # a groupetto keeps accidentals and beams
        for mark in token[m.end() :]:
            if SLOT_OF.get(mark) in ("accidental", "beam"):
                slots[SLOT_OF[mark]] += mark
            else:
                stats[mark] += 1
        return m[1] + "qq" + m[2] + slots["accidental"] + slots["beam"]
    grace = False
    lost: Stats = Counter()
    lead = re.match(r"[^0-9a-gA-Gr]*", token)[0]
    for k, mark in enumerate(lead):
        if mark == "q":
            grace = grace or (k + 1 == len(lead) and token[k + 1 : k + 2] in tuple(PITCHES))
        elif mark in SLOT_OF:
            slots[SLOT_OF[mark]] += mark
        else:
            lost[mark] += 1
    rest = token[len(lead) :]
    length = re.match(r"(?:\d+(?:%\d+)?\.*)?", rest)[0]
    rest = rest[len(length) :]
    if rest.startswith("r"):
        stats.update(lost)
        return length + "r" + slots["editorial"] + "".join(c for c in rest[1:] if SLOT_OF.get(c) == "editorial")
    if rest[:1] == "q" and rest[1:2] in tuple(PITCHES):
        grace, rest = True, rest[1:]
    pitch = re.match(r"([a-gA-G])\1*", rest)
    stats.update(lost)
    if not pitch:
        return token
    for mark in rest[pitch.end() :]:
        if mark == "q":
            grace = True
        elif mark in SLOT_OF:
            slots[SLOT_OF[mark]] += mark
        else:
            stats[mark] += 1
    head = length + pitch[0] + slots["accidental"]
    if grace:
        return head + "q" + slots["slur"] + slots["tie"] + slots["beam"]
    slots["ornament"] = "".join(sorted(slots["ornament"], key=MARKS["ornament"].index))
    return head + "".join(slots[s] for s in SLOTS[1:])


def canonicalize_note_order(text: str, stats: Stats) -> str:
    """Marks of each note in fixed order; unknown ones go and are counted."""
    return "\n".join("\t".join(" ".join(_canonical(t, stats) for t in f.split(" ")) for f in r.split("\t")) for r in text.split("\n"))


def _semitones(letters: str, sign: str) -> int:
    octave = 3 + len(letters) if letters[0].islower() else 4 - len(letters)
    return 12 * (octave + 1) + (0, 2, 4, 5, 7, 9, 11)["cdefgab".index(letters[0].lower())] + {"#": 1, "-": -1}.get(sign, 0)


def order_notes(text: str, stats: Stats) -> str:
    """Chords from low to high, the beam on the last note.  Rests and tokens without pitch drop out of a chord."""

    def field(f: str) -> str:
        if " " not in f or f[0] in "=*!" or not re.search("[a-gA-G]", f):
            return f
        notes = [m for t in f.split(" ") if (m := re.match(r"(\d+(?:%\d+)?\.*)?([a-gA-G]+)([#-]?)(.*)$", t, re.S))]
        if not notes:
            return f
        notes.sort(key=lambda m: _semitones(m[2], m[3]))
        beam = next((b for m in notes if (b := re.sub("[^LJKk]", "", m[4]))), "")
        return " ".join((m[1] or "") + m[2] + m[3] + re.sub("[LJKk]", "", m[4]) for m in notes) + beam

    return "\n".join("\t".join(map(field, r.split("\t"))) for r in text.split("\n"))


def symbols_before_split(text: str, stats: Stats) -> str:
    """An interpretation right after a split moves before it where the split spines agree."""
    rows = text.split("\n")
    for i in range(len(rows) - 1):
        found = rows[i + 1].split("\t")
        if not is_split(rows[i]) or not all(f[:1] == "*" and f[1:2].isalpha() for f in found):
            continue
        marks = [k for k, f in enumerate(rows[i].split("\t")) if f == "*^"]
        agreed = 0
        for j, k in reversed(list(enumerate(marks))):
            if k + j + 1 < len(found) and found[k + j + 1] == found[k + j]:
                del found[k + j + 1]
                agreed += 1
        if agreed == len(marks):
            rows[i], rows[i + 1] = "\t".join(found), rows[i]
    return "\n".join(rows)


def validate_spine_operations(text: str, stats: Stats) -> str:
    state: list[int] | None = None
    for line, r in enumerate(text.split("\n"), 1):
        if not r.strip():
            continue
        found = r.split("\t")
        state = state if state is not None else [0] * len(found)
        if len(found) != len(state):
            raise SpineError(f"line {line}: {len(found)} fields where {len(state)} spines are open: {r!r}")
        try:
            state = advance(state, found)
        except SpineError as why:
            raise type(why)(f"line {line}: {why}: {r!r}") from why
    return text


def repair_interpretation_spacing(text: str, stats: Stats) -> str:
    """Interpretation records with blanks for tabs get the tracked width, or the text is rejected."""
    out, state = [], None
    for line, r in enumerate(text.split("\n"), 1):
        if r.strip():
            state = state if state is not None else [0] * len(r.split("\t"))
            if len(r.split("\t")) != len(state) and all(f.strip().startswith("*") for f in r.split("\t") if f.strip()):
                tries = [re.sub(" {2,}", "\t", r), "\t".join(r.split())]
                fixed = next((t for t in tries if len(t.split("\t")) == len(state)), None)
                if fixed is None:
                    raise ValueError(f"line {line}: no way to read {len(state)} fields in {r!r}")
                r = fixed
            try:
                state = advance(state, r.split("\t"))
            except SpineError as why:
                raise ValueError(f"line {line}: {why}") from why
        out.append(r)
    return "\n".join(out)


def _chunks(text: str) -> list[list[list[str]]]:
    out: list[list[list[str]]] = [[]]
    for r in text.splitlines():
        out[-1].append(r.split("\t"))
        if is_bar(r) or is_split(r) or is_merge(r):
            out.append([])
    out = [c for c in out if c]
    if any(len({len(r) for r in c}) > 1 for c in out):
        raise ValueError("the width changes within a measure")
    return out


def _beams(chunk: list[list[str]]) -> None:
    """Balances beams within a chunk, spine by spine."""
    for j in range(len(chunk[0]) if chunk else 0):
        opened = 0
        for i, row in enumerate(chunk):
            f = row[j]
            starts, stops = is_note(f) and ("L" in f or "K" in f), "J" in f or is_note(f) and "k" in f
            if not starts and not stops:
                continue
            length = re.match(r"[\[\]()]*(\d+)", f)
            if not length and "q" in f:
                length = 8  # a grace note counts as an eighth
            elif not length:
                raise ValueError(f"no duration in {f}")
            else:
                length = int(length[1])
            need = max(0, int(math.log2(length)) - 2) if length else 0
            if starts:
                opened = min(opened, need)
                row[j] = f.replace("L", "").replace("K", "") + "L" * (need - opened)
                opened = need
                continue
            if opened > need:
                extra = opened - need
                k = next((k for k in range(i - 1, -1, -1) if "L" in chunk[k][j]), None)
                if k is None or not chunk[k][j].endswith("L" * extra):
                    raise ValueError(f"no beams to shorten before record {i + 1} in spine {j + 1}")
                chunk[k][j] = chunk[k][j][:-extra] + "K" * extra
                opened = need
            row[j] = f.replace("J", "").replace("k", "") + "J" * opened + "k" * (need - opened)
            opened = 0
        if opened:
            k = next((k for k in range(len(chunk) - 1, -1, -1) if is_note(chunk[k][j])), None)
            if k is None:
                raise ValueError("a beam without a note to end it")
            f = chunk[k][j]
            if "L" in f:
                if f.count("L") < opened:
                    raise ValueError("fewer beams than are open")
                chunk[k][j] = f.replace("L", "", opened)
            else:
                chunk[k][j] = f + "J" * opened


def fix_note_beams(text: str, stats: Stats) -> str:
    found = _chunks(text)
    for c in found:
        _beams(c)
    return "\n".join(_join(c) for c in found)


def _pitch(token: str) -> str | None:
    m = re.match(r"[\[\]()]*[\d.]*([A-Ga-g]+[#n-]*)", token)
    return m[1] if m else None


def fix_ties(text: str, stats: Stats) -> str:
    """A tie that ends without a start of its pitch loses its end; a continuation beside a start or an end goes."""
    opened: set[str | None] = set()

    def token(t: str) -> str:
        out = t.replace("_", "") if "_" in t and ("[" in t or "]" in t) else t
        if "[" in t and _pitch(t):
            opened.add(_pitch(t))
        if "]" in t:
            if _pitch(t) in opened:
                opened.remove(_pitch(t))
            else:
                out = t.replace("]", "")
        return out

    return _notes(text, token)


def fix_slurs(text: str, stats: Stats) -> str:
    """A slur that starts and ends on one note goes, and so does an end without a start."""
    depth = 0

    def token(t: str) -> str:
        nonlocal depth
        if "(" in t and ")" in t:
            return t.replace("(", "").replace(")", "")
        if "(" in t:
            depth += 1
        elif ")" in t:
            if not depth:
                return t.replace(")", "")
            depth -= 1
        return t

    return _notes(text, token)

