"""Filters and the rhythm checker: cases by hand, and the stream form against the batch form."""

import json
import random
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stavelake.operators import filters, rhythm, spines


def rows(*records):
    return "\n".join(r.replace(" | ", "\t") for r in records)


GOOD = rows("**kern | **text | **kern", "*clefF4 | * | *clefG2", "*M2/4 | * | *M2/4", "4c | la | 2e", "4d | . | .", "== | == | ==", "*- | *- | *-")
CASES = [
    (GOOD, None, None),
    ("", "termination", "Empty file"),
    ("\n\n", "termination", "Empty file"),
    ("!!!only\n!!!comments", "termination", "File contains only comments"),
    (GOOD + "\n!!!end\n", None, None),
    (GOOD.removesuffix("\t*-"), None, None),
    (rows("**kern", "*clefG2", "4c"), "termination", "Missing spine terminators"),
    (rows("*clefG2", "4c", "*-"), "header_clef", "No spine declaration found"),
    (rows("**kern | **kern", "*clefG2 | *", "4c | 4d", "* | *clefG2", "*- | *-"), "header_clef", "Missing header clef declaration"),
    (rows("**text | **ekern_1.0", "la | *", "* | *clefG2", "la | 4c", "*- | *-"), None, None),
    (rows("**kern", "*clefG2", "3%5c", "*-"), "rational_duration", "Rational duration found: 3%5"),
    (rows("**kern", "*clefG2", "4c###", "*-"), "accidentals", "Too many accidentals: c###"),
    (rows("**kern", "*clefG2", "4c##-", "*-"), None, None),
    (rows("**kern", "*clefG2", "4ccccccc", "*-"), "excessive_octave", "Excessive octave: ccccccc"),
]


def test_cascade(spark):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id int, text string")
    cascade = filters.Cascade([d for d in filters.DEFAULT if d["name"] != "rhythm"])
    checked = cascade(docs)
    got = {r.doc_id: (r.rejecting_filter, r.reason) for r in checked.collect()}
    assert got == {i: (c[1], c[2]) for i, c in enumerate(CASES)}
    stats = {r["filter"]: (r.reached, r.passed, r.failed) for r in cascade.stats(checked).collect()}
    names = [n for n, _ in cascade.checks]
    left = len(CASES)
    for n in names:
        failed = sum(c[1] == n for c in CASES)
        assert stats[n] == (left, left - failed, failed)
        left -= failed
    assert sum(r.n for r in filters.reasons(checked).collect()) == sum(c[1] is not None for c in CASES)


def test_rhythm_is_last_and_config(spark):
    short = rows("**kern", "*clefG2", "*M4/4", "=1", "1c", "=2", "4c", "=3", "1c", "==", "*-")
    docs = spark.createDataFrame([(0, GOOD), (1, short), (2, "")], "doc_id int, text string")
    got = {r.doc_id: (r.rejecting_filter, r.reason) for r in filters.Cascade(filters.DEFAULT)(docs).collect()}
    assert got[0] == (None, None) and got[1][0] == "rhythm" and "line 8" in got[1][1] and got[2][0] == "termination"
    one = filters.Cascade.from_config(json.dumps({"filters": [{"name": "accidentals", "params": {"max_accidentals": 1}}]}))
    assert one(spark.createDataFrame([(0, "4c##")], "doc_id int, text string")).first().rejecting_filter == "accidentals"
    with pytest.raises(ValueError, match="Available"):
        filters.Cascade([{"name": "nothing"}])
    bad = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff\xfe"),)], "content binary")
    assert [r[0] for r in bad.select(filters.utf8(bad.content)).collect()] == [None, "Invalid UTF-8 encoding"]


def score(*measures, head=("**kern", "*M4/4"), end=("*-",)):
    return rows(*head, *measures, *end)


RHYTHM = [
    (score("=1", "4c", "4d", "4e", "4f", "=2", "1g", "=="), [], 2),
    (score("4c", "=1", "1d", "=2", "2.e", "=="), [], 3),  # pickup, short end
    (score("=1", "1c", "=2", "2c", "=3", "1c", "=="), [(7, 2)], 3),
    (score("=1", "1c", "=2", "2c", "=3", end=()), [(7, 2)], 2),  # no end: held back, then told
    (score("=1", "1c", "=2", "2c", "=3"), [], 2),  # the end cancels it
    (score("=1", "1c", "=2", "1c 1e", "4c", "=3", "1c", "=="), [(8, 2)], 3),  # too long
    (score("4c", "=1", "1c", "=:|!", "2.c", "=:|!|:", "1c", "=="), [], 4),
    (score("4c", "=1", "1c", "=2", "2c", "=:|!", "1c", "=="), [(8, 3)], 4),  # 1/4 + 1/2
    (score("=1", "1c", "=!|:", "4c", "=3", "1c", "=4", "2.c", "=:|!", "1c", "=="), [], 5),  # a section's pickup
    (score("=1", "4.c", "8d", "8qe", "2r", "=2", "0c", "=3", "1c", "=="), [(10, 2)], 3),  # 0 is a breve
    (score("=1", "1c", "=2", "*M3/4", "2.c", "=3", "2.c", "=="), [], 3),  # a meter at the start of a measure holds for it
    (rows("**kern | **kern", "*M2/4 | *M2/4", "=1 | =1", "*^ | *", "4c | 4e | 2g", "4d | 4f | .", "*v | *v | *", "=2 | =2", "2c | 4d", "= | =", "2c | 2d", "== | ==", "*- | *-"), [(10, 2)], 3),
    (rows("**kern | **dynam", "*M2/4 | *", "=1 | =1", "2c | f", "=2 | =2", "2d | p", "== | ==", "*- | *-"), [], 2),
    (rows("**ekern", "*M2/4", "=1", "4c", "=2", "4c", "=="), [], 0),
]


@pytest.mark.parametrize("case", range(len(RHYTHM)))
def test_rhythm(case):
    text, errors, measures = RHYTHM[case]
    got = rhythm.check_text(text)
    assert ([(e.line, e.measure) for e in got["errors"]], got["measures_checked"]) == (errors, measures), got


def test_rhythm_options_and_warnings():
    text = RHYTHM[1][0]
    assert len(rhythm.check_text(text, allow_anacrusis=False)["errors"]) == 1
    assert len(rhythm.check_text(text, allow_incomplete_final=False)["errors"]) == 1
    odd = rhythm.check_text(rows("**kern", "*v", "c", "*-"))
    assert any("a lone *v" in w for w in odd["warnings"]) and any("no duration" in w for w in odd["warnings"])


def test_lines_one_by_one_equal_whole_text():
    for text, *_ in RHYTHM:
        pairs = list(enumerate(text.split("\n"), 1))
        random.Random(3).shuffle(pairs)
        assert rhythm.check_lines(pairs) == rhythm.check_text(text)


def test_column_and_summary(spark):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(RHYTHM)] + [(99, None)], "doc_id int, text string")
    done = docs.select("doc_id", rhythm.rhythm_column("text").alias("rhythm"))
    got = {r.doc_id: [(e.line, e.measure) for e in r.rhythm.errors] for r in done.collect()}
    assert all(got[i] == c[1] for i, c in enumerate(RHYTHM)) and got[99] == []
    s = rhythm.summary(done).first()
    assert (s.total_files, s.failed_files, s.total_errors) == (len(RHYTHM) + 1, sum(bool(c[1]) for c in RHYTHM), sum(len(c[1]) for c in RHYTHM))


@given(st.integers(1, 64), st.integers(0, 3))
def test_durations_are_exact(n, dots):
    assert rhythm.duration(f"({n}{'.' * dots}cc#") == Fraction(1, n) * (2 - Fraction(1, 2**dots))
    assert rhythm.duration(f"{n}%7{'.' * dots}r") == Fraction(n, 7) * (2 - Fraction(1, 2**dots))


def test_lineage_and_restored_width():
    text = rows("4c | 4d", "*^ | *", "4c | 4e | 4d", "=| =| =".replace("| ", " | "), "*- | *- | *-")
    first, last, error = spines.widths(text)
    assert (first, last, error) == (2, 3, None)
    assert spines.restore_width(text) == rows("4c | 4d", "*^ | *", "4c | 4e | 4d", "*v | *v | *", "= | =", "*- | *-")
    twice = rows("4c", "*^", "4c | 4d", "*^ | *", "4c | 4e | 4d", "== | == | ==")
    assert spines.restore_width(twice) == rows("4c", "*^", "4c | 4d", "*^ | *", "4c | 4e | 4d", "*v | *v | *v", "==")
    assert spines.widths(rows("4c | 4d", "4c"))[2] == "line 2: 1 fields where 2 spines are open"
    assert spines.widths("!! x\n")[2] and spines.restore_width(rows("4c", "4d | 4e")) == rows("4c", "4d | 4e")


@given(st.lists(st.sampled_from(["*^", "*", "*v", "*-"]), min_size=1, max_size=6))
def test_advance_counts(fields):
    state = list(range(len(fields)))
    try:
        out = spines.advance(state, fields)
    except spines.SpineError:
        assert any(len(p) == 1 for m, p in spines.merge_runs(fields) if m == "*v")
        return
    want = sum(1 if m in ("*v", "*") else 2 if m == "*^" else 0 for m, _ in spines.merge_runs(fields))
    assert len(out) == want
