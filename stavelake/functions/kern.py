"""Column functions over kern text: records (lines), spines (tabs) and tokens (spaces).

A document stays one string in one row.  Everything here is a Spark expression; nothing needs a shuffle or Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Rewrite = Callable[[Column], Column]

#: Fixed value: line ends beside the line feed.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Rewrite) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def records(text: Column | str) -> Column:
    """Lines split at line feeds; an empty text is one empty line."""
    return F.split(_c(text), "\n", -1)


def lines(text: Column | str) -> Column:
    """Lines split at any line end, without the empty line after the last one."""
    return F.split(F.regexp_replace(_c(text), f"(?:{LINE_END})\\z", ""), LINE_END, -1)


def fields(record: Column) -> Column:
    return F.split(record, "\t", -1)


def tokens(field: Column) -> Column:
    return F.split(field, " ", -1)


def first_field(record: Column) -> Column:
    return F.substring_index(record, "\t", 1)


def kind(record: Column) -> Column:
    """empty, exclusive, terminator, tandem, barline or data, told by the first field of the trimmed record."""
    r = F.trim(record)
    f = first_field(r)
    return (
        F.when((r == "") | r.startswith("!"), "empty")
        .when(f.startswith("**"), "exclusive")
        .when(f == "*-", "terminator")
        .when(f.startswith("*"), "tandem")
        .when(f.startswith("="), "barline")
        .otherwise("data")
    )


def all_fields(record: Column, test: Rewrite) -> Column:
    return F.forall(fields(record), test)


def is_bar_record(record: Column) -> Column:
    return record.rlike(r"^=[^\t]*(\t=[^\t]*)*$")


def is_terminator_record(record: Column) -> Column:
    return record.rlike(r"^\*-(\t\*-)*$")


def is_split_record(record: Column) -> Column:
    return record.rlike(r"^\*\^?(\t\*\^?)*$") & record.contains("*^")


def is_merge_record(record: Column) -> Column:
    return record.rlike(r"^\*v?(\t\*v?)*$") & record.contains("*v")


def is_interpretation_record(record: Column) -> Column:
    return record.rlike(r"^\*[^\t]*(\t\*[^\t]*)*$")


def is_data_record(record: Column) -> Column:
    """Neither blank nor a comment, interpretation or barline, and not null in every spine."""
    return ~record.rlike(r"^$|^[!*=]|^\.(\t\.)*$")


def is_note(token: Column) -> Column:
    return ~token.rlike(r"^[*!]") & token.rlike("[a-gA-G]")


def is_grace(token: Column) -> Column:
    return token.contains("q")


def duration(token: Column) -> Column:
    """Leading digits after ties and slurs, else null."""
    d = F.regexp_extract(token, r"^[\[\]()]*(\d+)", 1)
    return F.when(d != "", d.cast("long"))


def pitch(token: Column) -> Column:
    """Pitch letters with accidentals after leading ties, slurs, digits and dots, else null."""
    p = F.regexp_extract(token, r"^[\[\]()]*[\d.]*([A-Ga-g]+[#n-]*)", 1)
    return F.when(p != "", p)


def is_rest(token: Column) -> Column:
    return token.rlike(r"^[\[\](){}_.0-9]*r")


def midi(token: Column) -> Column:
    """Semitones of a note: a lower-case letter is octave 4 and each repeat one up, a capital octave 3 and each repeat
    one down; one accidental counts."""
    letters = F.regexp_extract(token, r"^[\d.%]*([a-gA-G]+)", 1)
    first = F.substring(letters, 1, 1)
    n = F.length(letters)
    octave = F.when(first == F.lower(first), 3 + n).otherwise(4 - n)
    semitone = F.element_at(F.array(*map(F.lit, (0, 2, 4, 5, 7, 9, 11))), F.instr(F.lit("cdefgab"), F.lower(first)))
    sign = F.regexp_extract(token, r"^[\d.%]*[a-gA-G]+([#-])", 1)
    return F.when(letters != "", 12 * (octave + 1) + semitone + F.when(sign == "#", 1).when(sign == "-", -1).otherwise(0))


def map_records(text: Column, rewrite: Rewrite, split: Rewrite = records) -> Column:
    return F.array_join(F.transform(split(text), rewrite), "\n")


def map_fields(text: Column, rewrite: Rewrite, split: Rewrite = records) -> Column:
    return map_records(text, lambda r: F.array_join(F.transform(fields(r), rewrite), "\t"), split)


def map_tokens(text: Column, rewrite: Rewrite, split: Rewrite = records) -> Column:
    return map_fields(text, lambda f: F.array_join(F.transform(tokens(f), rewrite), " "), split)


def map_notes(text: Column, rewrite: Rewrite) -> Column:
    """Rewrites note tokens; line ends become line feeds and the last one goes."""
    return map_tokens(text, lambda t: F.when(is_note(t), rewrite(t)).otherwise(t), lines)


def keep_records(text: Column, keep: Rewrite) -> Column:
    return F.array_join(F.filter(records(text), keep), "\n")


def strip_markers(text: Column | str) -> Column:
    """Note tokens without tie and beam markers."""
    return map_notes(_c(text), lambda t: F.translate(t, "[]_LJKk", ""))


def project_pitches(text: Column | str) -> Column:
    """Data records with each token cut to its pitch, rests to ``r``; records left without any go."""

    def token(t: Column) -> Column:
        return F.when(t == ".", t).when(is_rest(t), "r").otherwise(pitch(t))

    def field(f: Column) -> Column:
        return F.array_join(F.filter(F.transform(tokens(f), token), lambda t: t.isNotNull()), " ")

    data = F.filter(lines(_c(text)), lambda r: ~F.trim(r).rlike(r"^$|^[!*=]"))
    return F.array_join(F.filter(F.transform(data, lambda r: F.array_join(F.transform(fields(r), field), "\t")), lambda r: r.rlike(r"[^\t]")), "\n")


def with_header(text: Column | str) -> Column:
    """A ``**kern`` line over as many spines as the first record has, where there is none."""
    c = _c(text)
    width = F.size(fields(records(c)[0]))
    return F.when(records(c)[0].startswith("**"), c).otherwise(F.concat(F.array_join(F.array_repeat(F.lit("**kern"), width), "\t"), F.lit("\n"), c))


def with_terminator(text: Column | str) -> Column:
    """A ``*-`` line over as many spines as the last record has, where there is none; trailing line feeds go."""
    c = F.regexp_replace(_c(text), "\n+$", "")
    last = F.element_at(records(c), -1)
    line = F.array_join(F.array_repeat(F.lit("*-"), F.size(fields(last))), "\t")
    return F.when((c == "") | is_terminator_record(last), c).otherwise(F.concat(c, F.lit("\n"), line))


def ekern_to_kern(text: Column | str) -> Column:
    """Extended kern to kern: the header's name, and without the marks between token parts."""
    return F.translate(F.regexp_replace(_c(text), r"\*\*ekern[^\t\n]*", "**kern"), "@·", "")


def chunks(text: Column | str) -> Column:
    """Runs of records that end with a barline, split or merge record; null where the width changes within one."""
    ends = lambda r: is_bar_record(r) | is_split_record(r) | is_merge_record(r)

    def cut(rs: Column) -> Column:
        marks = F.filter(F.transform(rs, lambda r, i: F.when(ends(r) | (i == F.size(rs) - 1), i)), lambda i: i.isNotNull())
        return let(marks, lambda m: F.transform(m, lambda to, k: F.slice(rs, F.when(k == 0, 1).otherwise(F.get(m, k - 1) + 2), to - F.when(k == 0, -1).otherwise(F.get(m, k - 1)))))

    width = lambda p: F.array_distinct(F.transform(p, lambda r: F.size(fields(r))))
    return let(let(lines(_c(text)), cut), lambda parts: F.when(F.forall(parts, lambda p: F.size(width(p)) == 1), F.transform(parts, lambda p: F.array_join(p, "\n"))))


def drop_header(text: Column | str) -> Column:
    """From the first record on that is not all interpretations; nothing is left of a text without one."""

    def cut(rs: Column) -> Column:
        first = F.array_min(F.transform(rs, lambda r, i: F.when(~is_interpretation_record(r), i)))
        return let(first, lambda k: F.when(k.isNull(), "").otherwise(F.array_join(F.slice(rs, k + 1, F.size(rs)), "\n")))

    c = _c(text)
    return F.when(c == "", c).otherwise(let(lines(c), cut))


def remove_first_meter(text: Column | str) -> Column:
    """Without the first record that has a meter in any spine."""

    def cut(rs: Column) -> Column:
        first = F.array_min(F.transform(rs, lambda r, i: F.when(r.rlike(r"(?:^|\t)\*M\d+(?:\+\d+)*/\d+(?:\+\d+/\d+)*(?:\t|$)"), i)))
        return let(first, lambda k: F.array_join(F.filter(rs, lambda r, i: k.isNull() | (i != k)), "\n"))

    return let(records(_c(text)), cut)


def squeeze_newlines(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), "\n+", "\n")


def remove_last_bar(text: Column | str) -> Column:
    """Up to the last barline before the last content, and terminators over as many spines; a text without one stays."""
    c = _c(text)

    def cut(rs: Column) -> Column:
        content = F.array_max(F.transform(rs, lambda r, i: F.when(~is_bar_record(r) & ~is_terminator_record(r), i)))
        return let(let(content, lambda k: F.array_max(F.transform(rs, lambda r, i: F.when(is_bar_record(r) & (i <= k), i)))), lambda at: ended(rs, at))

    def ended(rs: Column, at: Column) -> Column:
        end = F.array_join(F.transform(fields(F.get(rs, at)), lambda f: F.lit("*-")), "\t")
        return F.when(at.isNull(), c).otherwise(F.concat(F.array_join(F.slice(rs, F.lit(1), at + 1), "\n"), F.lit("\n"), end))

    return let(records(c), cut)
