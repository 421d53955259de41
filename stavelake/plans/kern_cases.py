"""Score texts with every construct that the passes, the filters and the rhythm checker treat, one for each order.

A case is a pair of templates: the text, and what must come of it, written by hand.  Each order takes the case of its key
and puts its own pitch, duration and bar number into both, so the text is made in Spark and the expectation in SQL.  In a
template records are parted by ``;`` and spines by ``|``; ``{p}`` is a pitch letter, ``{d}`` a duration (1 to 8), ``{n}`` a
number from 10 on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PITCHES = "cdefgab"


def spelled(template: str) -> str:
    return template.replace(";", "\n").replace("|", "\t").replace("¦", "|").replace("§", ";")


def filled(template: Column) -> Column:
    """``template`` with the values of the order in the row."""
    pitch = F.substring(F.lit(PITCHES), (F.col("o_orderkey") % 7).cast("int") + 1, F.lit(1))
    duration = F.pow(F.lit(2), F.col("o_custkey") % 4).cast("long").cast("string")
    out = F.replace(template, F.lit("{p}"), pitch)
    out = F.replace(out, F.lit("{d}"), duration)
    return F.replace(out, F.lit("{n}"), (F.col("o_orderkey") % 90 + 10).cast("long").cast("string"))


def case_view(orders: DataFrame, templates: list[str]) -> DataFrame:
    """(doc_id, text)."""
    chosen = F.element_at(F.array(*(F.lit(spelled(t)) for t in templates)), (F.col("o_orderkey") % len(templates)).cast("int") + 1)
    return orders.select(F.col("o_orderkey").alias("doc_id"), filled(chosen).alias("text"))


def expected_sql(columns: dict[str, list[str | int | None]]) -> str:
    """``select doc_id, ...`` with the expectation of each case; strings are templates."""
    shown = []
    for name, values in columns.items():
        quoted = ["null" if v is None else str(v) if isinstance(v, int) else "'" + spelled(v).replace("'", "''") + "'" for v in values]
        case = f"case o_orderkey % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(quoted)) + " end"
        if all(isinstance(v, str | None) for v in values) and any(v for v in values):
            case = f"replace(replace(replace({case}, '{{p}}', substr('{PITCHES}', cast(o_orderkey % 7 as int) + 1, 1)), '{{d}}', cast(1 << cast(o_custkey % 4 as int) as varchar)), '{{n}}', cast(o_orderkey % 90 + 10 as varchar))"
        shown.append(f"{case} as {name}")
    return f"select o_orderkey as doc_id, {', '.join(shown)} from orders"


HEAD = "*clefF4|*clefG2;*k[]|*k[];*M4/4|*M4/4"
# Before and after each pass; after None: rejected with the error in the third place.
PASSES: dict[str, list[tuple]] = {
    "remove_non_kern_spines": [
        ("**kern|**text|**kern;*^|*|*;4{p}|4d|la|{d}e;*v|*v|*|*;4c|la|4{p};!! note;*-|*-|*-", "**kern|**kern;*^|*;4{p}|4d|{d}e;*v|*v|*;4c|4{p};!! note;*-|*-"),
        ("**kern|**ekern_1.0;{d}{p}|4d;*-|*-", "**kern|**ekern_1.0;{d}{p}|4d;*-|*-"),
        ("**dynam|**kern;f|4{p};*|*^;p|4{p}|4e;.|4c|4c;*|*v|*v;p|{d}{p};*-|*-", "**kern;4{p};*^;4{p}|4e;4c|4c;*v|*v;{d}{p};*-"),
        ("**kern|**text;*x|*x", None, "SpineError"),
    ],
    "cleanup_kern": [
        ("!!!COM: x;**kern|**kern;*Ipiano|*staff1;*MM{n}|*MM{n};*clefG2|*clefX;={n}|={n};4{p}/@16@|8ddL\\Ls;8eJs 4g'^~|4fNyj<>RZS$&p;*Xtuplet|*tuplet;*A:|*k[f#];*-|*-", "*clefG2|*clefX;=|=;4{p}|8ddLL;8eJ 4g|4f;*|*k[f#];*-|*-"),
        ("**kern_x|**kern;*part{n}|*part2;*cue|*Xcue;*Trd-1c-2|*;*k[f#]|*k[];={n}:¦!|={n}:¦!;{d}{p}X|4e;! a|! b", "*k[f#]|*k[];=:¦!|=:¦!;{d}{p}|4e"),
    ],
    "strip_terminal_terminator": [("4{p}|{d}e;*-|*-;*-|*-;", "4{p}|{d}e"), ("{d}{p};*-|4d", "{d}{p};*-|4d"), ("*-|*-", "")],
    "normalize_rscale": [
        ("*rscale:2|*;4{p}|4d;*rscale:1|*;8.{p} 4.e|[4d", "2{p}|4d;8.{p} 4.e|[4d"),
        ("*clefG2|*rscale:1/2;4{p}|1d 0e qf;=|=;*|*", "*clefG2|*;4{p}|2d 1e qf;=|="),
        ("*^|*;4{p}|4e|4c;*rscale:2|*rscale:2|*;8{p}|16e|8c;*v|*v|*;8e|8c", "*^|*;4{p}|4e|4c;4{p}|8e|8c;*v|*v|*;4e|8c"),
        ("4{p}|4d;4c", None, "ValueError"),
        ("*rscale:3;4{p}", None, "ValueError"),
        ("*rscale:2|*;*v|*v", None, "ValueError"),
    ],
    "remove_grace_rests": [("4qr@ 4{p}|qryy;r|q{p};{d}r|4.qr", ". 4{p}|.;r|q{p};{d}r|.")],
    "remove_redundant_stria": [
        ("*stria5|*stria1;4{p}|4d;*stria5|*;{d}e|4f;*stria4|*;4g|4a;*stria4|*", "*stria5|*stria1;4{p}|4d;{d}e|4f;*stria4|*;4g|4a;"),
        ("*clefG2|*clefG2;4{p}|4d;*stria5|*stria5", "*clefG2|*clefG2;4{p}|4d;*stria5|*stria5"),
    ],
    "remove_leading_barlines": [("*M3/4|*M3/4;={n}|={n};.|.;4{p}|4e;=|=", "*M3/4|*M3/4;.|.;4{p}|4e;=|="), ("*M3/4;={n}", None, "ValueError"), ("{d}{p};=;4c", "{d}{p};=;4c")],
    "remove_null_lines": [(".|.;4{p}|.;.|{d}r;.", "4{p}|.;.|{d}r")],
    "canonicalize_barlines": [("=¦!|=¦!;==:¦!|=;4{p}=¦!|=¦!;{d}c|4d", "=|=;=:¦!|=;4{p}=¦!|=¦!;{d}c|4d")],
    "merge_split_normalizer": [
        ("4{p}|4d|4e;*v|*v|*;={n}|={n};*^|*;{d}c|4d|4e", "4{p}|4d|4e;={n}|={n}|={n};{d}c|4d|4e"),
        ("*|*v|*v;==|==;*-|*-", "==|==|==;*-|*-|*-"),
        ("*|*v|*v;*-|*-", "*-|*-|*-"),
        ("*v|*v|*;=|=;4{p}|{d}d", "*v|*v|*;=|=;4{p}|{d}d"),
    ],
    "canonicalize_spine_splits": [("*^|*;*|*|*^;4{p}|4c|4d|{d}e", "*^|*^;4{p}|4c|4d|{d}e"), ("*^|*;*^|*|*;4{p}|4c|4d|{d}e", "*^|*;*^|*|*;4{p}|4c|4d|{d}e")],
    "hoist_spine_splits_to_barline": [
        ("={n}|={n};4{p}|4e;*^|*;4c|4d|4e", "={n}|={n};*^|*;4{p}|4ryy|4e;4c|4d|4e"),
        ("=|=;{d}{p}|{d}e;{d}.c|4e;*|*^;4c|4d|4e", "=|=;*|*^;{d}{p}|{d}e|{d}ryy;{d}.c|4e|4ryy;4c|4d|4e"),
        ("=|=;.|4e;*^|*;4{p}|4d|4e", "=|=;.|4e;*^|*;4{p}|4d|4e"),
        ("=|=;4{p} 8e|4e;*^|*;4c|4d|4e", "=|=;4{p} 8e|4e;*^|*;4c|4d|4e"),
    ],
    "delay_spine_merges_to_barline": [
        ("4c|4d|4e;*v|*v|*;{d}.{p}|4d;=|=", "4c|4d|4e;{d}.{p}|{d}.ryy|4d;*v|*v|*;=|="),
        ("*v|*v|*;*clefG2|*;=|=", "*v|*v|*;*clefG2|*;=|="),
        ("*v|*v;4{p}", "*v|*v;4{p}"),
    ],
    "cap_slurs": [("((((4{p}{p}|(4c;{d}d))))|4e)", "((4{p}{p}|(4c;{d}d))|4e)")],
    "remove_redundant_time_signatures": [
        ("*met(c)|*met(c);*M4/4|*M4/4;4{p}|4d", "*met(c)|*met(c);4{p}|4d"),
        ("*M2/2|*;*met(C¦)|*met(C¦);{d}{p}|4d", "*met(C¦)|*met(C¦);{d}{p}|4d"),
        ("*met(c);4{p};*M4/4", "*met(c);4{p};*M4/4"),
        ("*met(c);*M3/4;4{p}", "*met(c);*M3/4;4{p}"),
    ],
    "canonicalize_header_order": [
        ("*M4/4|*M4/4;*k[f#]|*k[];*clefG2|*;*stria5|*stria5;4{p}|4d;*k[]|*k[];*clefF4|*clefF4", "*stria5|*stria5;*clefG2|*;*k[f#]|*k[];*M4/4|*M4/4;4{p}|4d;*k[]|*k[];*clefF4|*clefF4"),
        ("*k[]|*clefG2;*M4/4|*M4/4;{d}{p}|4c", "*k[]|*clefG2;*M4/4|*M4/4;{d}{p}|4c"),
    ],
    "merge_header_clef_lines": [("*clefF4|*clefG2;*|*clefF4;*k[]|*k[];4{p}|4d;*clefG2|*;*|*clefG2", "*clefF4|*clefF4;*k[]|*k[];4{p}|4d;*clefG2|*;*|*clefG2")],
    "normalize_null_keysig": [("*|*k[b-];*|*;4{p}|4c;*k[f#c#]|*", "*k[]|*k[b-];*|*;4{p}|4c;*k[f#c#]|*k[]")],
    "canonicalize_note_order": [
        ("[8{p}J|(4{p}#L;8q{p}|8cTmw§vL;4c[,L|8d)o;4qqcL-|yy4r", "8{p}[J|4{p}#(L;8{p}q|8c§TmwvL;4c,[L|8do);4qqc-L|4ryy"),
        ("{d}{p}?Q#|=;4x|4cc##k[[", "{d}{p}#|=;4x|4cc##[[k"),
    ],
    "order_notes": [("4g 4e 4c|4C 4CC;8ccL 8eL 4r|{d}c#J {d}c", "4c 4e 4g|4CC 4C;8e 8ccL|{d}c {d}c#J"), ("4{p}{p} 4{p}|{d}r", "4{p} 4{p}{p}|{d}r")],
    "symbols_before_split": [("*|*^;*clefF4|*clefG2|*clefG2;*k[]|*k[]|*k[];4{p}|4c|{d}d", "*clefF4|*clefG2;*k[]|*k[];*|*^;4{p}|4c|{d}d"), ("*^|*;*a|*b|*c;4{p}|4c|{d}d", "*^|*;*a|*b|*c;4{p}|4c|{d}d")],
    "remove_contradictory_accidentals": [("16{p}#n 4e-n|4{p}##n;*k[f#-]|{d}d-#", "16{p}n 4en|4{p}n;*k[f#-]|{d}d#")],
    "remove_conflicting_bowings": [("8{p}{p}vuL|4Du;{d}cv|4e", "8{p}{p}vL|4Du;{d}cv|4e")],
    "remove_null_ties": [("4G[[]]|4{p}();4c[[|4d__ 4e(())x;4r[]|{d}{p}]", "4G|4{p};4c[|4d_ 4ex;4r[]|{d}{p}]")],
    "validate_spine_operations": [
        ("4{p}|4d;*^|*;4c|4d|4e;*v|*v|*;{d}c|4d;*-|*-", "4{p}|4d;*^|*;4c|4d|4e;*v|*v|*;{d}c|4d;*-|*-"),
        ("4{p}|4d;4c", None, "SpineError"),
        ("4{p}|4d;*v|*", None, "SpineError"),
        ("4{p}|4d;*x|*x", None, "UnsupportedSpineOperation"),
    ],
    "repair_interpretation_spacing": [("4{p}|4d|4e;*|*Xtuplet    *", "4{p}|4d|4e;*|*Xtuplet|*"), ("4{p}|4d;*a", None, "ValueError"), ("{d}{p}|4d;*clefG2 *clefF4;4e|4f", "{d}{p}|4d;*clefG2|*clefF4;4e|4f")],
    "fix_note_beams": [("8{p}L;8d;=;8eJ;8f", "8{p}L;8dJ;=;8ek;8f"), ("16{p}L;16dJ;4{p}", "16{p}LL;16dJJ;4{p}")],
    "fix_ties": [("4{p}]|[4d;4e_]|4d];4d]|{d}c", "4{p}|[4d;4e_|4d];4d|{d}c")],
    "fix_slurs": [("4{p})|(4d);(4e|4c;4f)|{d}d;4g)|4a", "4{p}|4d;(4e|4c;4f)|{d}d;4g|4a")],
    "normalize_final_barline": [("=|=;4{p}|4d;=¦¦|=;*-|*-", "=|=;4{p}|4d;==|==;*-|*-"), ("={n}|={n};{d}{p}|4c;=!¦:|=", "={n}|={n};{d}{p}|4c;=:¦!|=")],
}

# Texts, the filter that rejects them (None: none), and the reason.
FILTERS: list[tuple[str, str | None, str | None]] = [
    ("**kern|**text|**kern;*clefF4|*|*clefG2;*M2/4|*|*M2/4;4{p}|la|2e;4d|.|.;==|==|==;*-|*-|*-;!!!end", None, None),
    (";", "termination", "Empty file"),
    ("!!!only {n};!!!comments", "termination", "File contains only comments"),
    ("**kern;*clefG2;4{p}", "termination", "Missing spine terminators"),
    ("*clefG2;4{p};*-", "header_clef", "No spine declaration found"),
    ("**kern|**kern;*clefG2|*;4{p}|4d;*|*clefG2;*-|*-", "header_clef", "Missing header clef declaration"),
    ("**kern;*clefG2;{n}%7{p};*-", "rational_duration", "Rational duration found: {n}%7"),
    ("**kern;*clefG2;4{p}###;*-", "accidentals", "Too many accidentals: {p}###"),
    ("**kern;*clefG2;4{p}{p}{p}{p}{p}{p}{p};*-", "excessive_octave", "Excessive octave: {p}{p}{p}{p}{p}{p}{p}"),
    ("**kern;*clefG2;*M4/4;={n};1{p};=;4{p};=;1c;==;*-", "rhythm", None),
]

# Texts, measures, errors and the line of the first error.
RHYTHM: list[tuple[str, int, int, int | None]] = [
    ("**kern;*M4/4;={n};4{p};4d;4e;4f;=;1g;==;*-", 2, 0, None),
    ("**kern;*M4/4;4{p};=;1d;=;2.e;==;*-", 3, 0, None),  # pickup, short end
    ("**kern;*M4/4;=;1c;=;2{p};=;1c;==;*-", 3, 1, 7),
    ("**kern;*M4/4;=;1c;=;1c 1e;4{p};=;1c;==;*-", 3, 1, 8),  # too long
    ("**kern;*M4/4;4{p};=;1c;=:¦!;2.c;=:¦!¦:;1c;==;*-", 4, 0, None),  # a repeat's pickup
    ("**kern;*M4/4;4{p};=;1c;=;2c;=:¦!;1c;==;*-", 4, 1, 8),
    ("**kern;*M4/4;=;4.{p};8d;8qe;2r;=;0c;=;1c;==;*-", 3, 1, 10),  # a breve
    ("**kern;*M4/4;=;1c;=;*M3/4;2.{p};=;2.c;==;*-", 3, 0, None),
    ("**kern|**kern;*M2/4|*M2/4;=|=;*^|*;4c|4e|2g;4d|4f|.;*v|*v|*;=|=;2{p}|4d;=|=;2c|2d;==|==;*-|*-", 3, 1, 10),
    ("**kern|**dynam;*M2/4|*;=|=;2{p}|f;=|=;2d|p;==|==;*-|*-", 2, 0, None),
    ("**kern;*M{n}/3;=;4{p};=;4c;==;*-", 2, 0, None),  # no meter
]

# Texts, and counters after them: splits, merges, ottava marks, control lines in a row.
GUARD: list[tuple] = [
    ("*^|*;4{p}|4c|4d;*v|*v|*;", 1, 2, 0, 1),
    ("*8va|*;4{p}|{d}d;*X8va|*;*^|*;*|*|*^;", 2, 0, 2, 3),
    ("*8va;*X8va;*8va;*X8va;4{p};" + "*8va;*X8va;" * 3, 0, 0, 10, 6),
    ("4{p}|4c;*^", 0, 0, 0, 0),
    ("*^;" * 40 + "4{p};", 40, 0, 0, 0),
]
# Markers that may not follow the texts above: all of them after too many control lines, else by their caps.
GUARD_BLOCKED = [0, 0, 16, 0, 1]

# Sequences as they were generated (with an end mark), and what is kept of them: cut at the first record that cannot be.
FINALIZED: list[tuple[str, str, int]] = [
    ("**kern;*M4/4;=;1{p};=;2c;4d;4e;=;*-", "**kern;*M4/4;=;1{p};=;2c;4d;4e;=;*-", 0),
    ("**kern;*M4/4;=;1{p};=;2c;4d;2e;=;1c;*-", "**kern;*M4/4;=;1{p};=;2c;4d;2e;*-", 1),
    ("**kern;*M4/4;=;1{p};=;2c;=;1d;*-", "**kern;*M4/4;=;1{p};=;2c;=;*-", 1),
    ("*M2/4|*M2/4;4{p}|2d;4c|.;=|=;4e|4f;4e|.;*-|*-", "*M2/4|*M2/4;4{p}|2d;4c|.;=|=;4e|4f;*-|*-", 1),
    ("*M2/4|*M2/4;4{p}|4d;4c|8d;.|8e;=|=;2c|2d;==|==;*-|*-", "*M2/4|*M2/4;4{p}|4d;4c|8d;.|8e;=|=;2c|2d;==|==;*-|*-", 0),
    ("4{p}|4d;*^|*;4c|4e|4d;4c|4d;*-|*-", "4{p}|4d;*^|*;4c|4e|4d;*-|*-|*-", 1),
]

STRINGS: dict[str, list[tuple[str, str]]] = {
    "drop_header": [("*clefG2|*clefF4;*k[]|*k[];4{p}|4d;*clefF4|*;=|=", "4{p}|4d;*clefF4|*;=|="), ("*clefG2;*M{n}/4", ""), ("{d}{p};*clefG2", "{d}{p};*clefG2")],
    "remove_first_meter": [("*k[]|*;*M{n}/4|*;4{p}|4d;*M3/4|*M3/4", "*k[]|*;4{p}|4d;*M3/4|*M3/4"), ("*MM{n};{d}{p}", "*MM{n};{d}{p}"), ("*M3/8+3/8;{d}{p}", "{d}{p}")],
    "squeeze_newlines": [("4{p};;;{d}d;", "4{p};{d}d;"), (";;4{p}", ";4{p}")],
    "with_header": [("{d}{p}|4c;*-|*-", "**kern|**kern;{d}{p}|4c;*-|*-"), ("**kern;4{p}", "**kern;4{p}")],
    "with_terminator": [("**kern|**kern;{d}{p}|4c;;", "**kern|**kern;{d}{p}|4c;*-|*-"), ("4{p};*-", "4{p};*-"), ("", "")],
    "ekern_to_kern": [("**ekern_1.0|**ekern;{d}@{p}·#|4@e·L", "**kern|**kern;{d}{p}#|4eL")],
    "strip_markers": [("*k[f#]|*;[8{p}L|8e_J;16ffkk]|r", "*k[f#]|*;8{p}|8e;16ff|r")],
    "remove_last_bar": [("=|=;4{p}|4d;=|=;4c|4d;==|==;*-|*-", "=|=;4{p}|4d;=|=;*-|*-"), ("4{p};4d;==;*-", "4{p};4d;==;*-"), ("={n};{d}{p};*^;4c|4d", "={n};*-")],
}

# Texts, spines at the start, at the end and after the first width is restored (None: broken), and the reason in words.
WIDTHS: list[tuple] = [
    ("**kern|**kern;4{p}|4d;*^|*;4c|4e|4d;=|=|=;*-|*-|*-", 2, 3, 2, None),
    ("**kern;{d}{p};*-", 1, 1, 1, None),
    ("**kern|**kern;*^|*;4{p}|4e|4d;*v|*v|*;=|=;*-|*-", 2, 2, 2, None),
    ("4{p}|4d;4c", None, None, None, "line 2: 1 fields where 2 spines are open"),
    ("!! {n}", None, None, None, "nothing but blanks and comments"),
]

# Segments parted by @, and what they are stitched to, or why they cannot be.
COMPOSED: list[tuple[str, str | None, str | None]] = [
    ("**kern|**kern;*clefF4|*clefG2;*k[]|*k[];*M4/4|*M4/4;=1|=1;1C|1{p};==|==;*-|*-@**kern|**kern;*clefF4|*clefF4;*k[f#]|*k[];*M4/4|*M4/4;=1|=1;1D|1{p};==|==;*-|*-", "**kern|**kern;*clefF4|*clefG2;*k[]|*k[];*M4/4|*M4/4;=1|=1;1C|1{p};==|==;*|*clefF4;*k[f#]|*;=1|=1;1D|1{p};==|==;*-|*-;", None),
    ("**kern;*clefG2;*M3/4;={n};2.{p};=;*-@**kern;*clefG2;*M2/4;=1;2{p};==;*-", "**kern;*clefG2;*M3/4;={n};2.{p};=;*M2/4;=1;2{p};==;*-;", None),
    ("**kern;*clefG2;4{p};*-", "**kern;*clefG2;4{p};*-;", None),
    ("**kern|**kern;4{p}|4c;*-|*-@**kern;4{p};*-", None, "a segment of 1 spines after one of 2"),
]

# Texts, chunks, and the longest proper prefix that is offered.
PREFIXES: list[tuple[str, int, str | None]] = [
    ("**kern;4{p};=1;4d;*^;4e|4f;*v|*v;4g;=2;4a", 4, "**kern;4{p};=1;4d;*^;4e|4f;*v|*v;4g;=2"),
    ("**kern;{d}{p}", 0, None),
    ("4{p};=;4c;=;4d", 2, "4{p};=;4c;="),
]

# Texts with notes, with splits, merges, exchanges and ends of spines.
MARKS: list[tuple] = [("**kern|**kern;*^|*;4{p}|4c|4d;*v|*v|*;*x|*x;*-|*-", 1, 1, 2, 2, 2), ("**kern;={n};!c;*-", 0, 0, 0, 0, 1), ("{d}r", 1, 0, 0, 0, 0)]
