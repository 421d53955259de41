"""Passes: before and after, errors as data, and properties of the pipeline."""

import json
import random
from collections import Counter

import pytest

from stavelake.operators.normalize import FULL, REGISTRY, Pipeline, dropped_marks, rejection_counts

T = "\t"


def rows(*records):
    return "\n".join(r.replace(" | ", T) for r in records)


PAIRS = {
    "remove_non_kern_spines": [
        (rows("**kern | **text | **kern", "*^ | * | *", "4c | 4d | la | 4e", "*v | *v | * | *", "4c | la | 4e", "!! note", "odd"), rows("**kern | **kern", "*^ | *", "4c | 4d | 4e", "*v | *v | *", "4c | 4e", "!! note", "odd")),
        (rows("**kern | **kern", "4c | 4d"), rows("**kern | **kern", "4c | 4d")),
    ],
    "cleanup_kern": [
        (rows("!!!COM: x", "**kern | **kern", "*Ipiano | *staff1", "*MM120 | *MM120", "*clefG2 | *clefX", "=12 | =12", "4c/@16@ | 8ddL\\Ls", "8eJs 4g'^~ | 4fNyj<>RZS$&p", "*Xtuplet | *tuplet", "*A: | *k[f#]", "*- | *-"), rows("*clefG2 | *clefX", "= | =", "4c | 8ddLL", "8eJ 4g | 4f", "* | *k[f#]", "*- | *-")),
    ],
    "strip_terminal_terminator": [(rows("4c", "*-", "*-") + "\n", "4c"), (rows("*- | *-"), ""), (rows("4c", "*- | 4d"), rows("4c", "*- | 4d"))],
    "normalize_rscale": [
        (rows("*rscale:2 | *", "4c | 4d", "*rscale:1 | *", "8.c 4.e | [4d"), rows("2c | 4d", "8.c 4.e | [4d")),
        (rows("*clefG2 | *rscale:1/2", "4c | 1d 0e qf", "= | =", "* | *"), rows("*clefG2 | *", "4c | 2d 1e qf", "= | =")),
    ],
    "remove_grace_rests": [(rows("4qr@ 4c | qryy", "r | q"), rows(". 4c | .", "r | q"))],
    "remove_redundant_stria": [(rows("*stria5 | *stria1", "4c | 4d", "*stria5 | *", "4e | 4f", "*stria4 | *", "4g | 4a", "*stria4 | *"), rows("*stria5 | *stria1", "4c | 4d", "4e | 4f", "*stria4 | *", "4g | 4a", ""))],
    "remove_leading_barlines": [(rows("*M3/4 | *M3/4", "= | =", ". | .", "4c | 4e", "= | ="), rows("*M3/4 | *M3/4", ". | .", "4c | 4e", "= | ="))],
    "remove_null_lines": [(rows(". | .", "4c | .", "", "."), rows("4c | .", ""))],
    "canonicalize_barlines": [(rows("=|! | =|!", "==:|! | =", "4c=|! | =|!") + "\n", rows("= | =", "=:|! | =", "4c=|! | =|!"))],
    "merge_split_normalizer": [
        (rows("*v | *v | *", "= | =", "*^ | *"), rows("= | = | =")),
        (rows("* | *v | *v", "== | ==", "*- | *-"), rows("== | == | ==", "*- | *- | *-")),
        (rows("* | *v | *v", "*- | *-"), rows("*- | *- | *-")),
        (rows("*v | *v | *", "= | =", "4c | 4d"), rows("*v | *v | *", "= | =", "4c | 4d")),
        (rows("*v | *v", "4c"), rows("*v | *v", "4c")),
        (rows("*v | *v | *", "=", ""), rows("*v | *v | *", "= | =", "")),
    ],
    "canonicalize_spine_splits": [(rows("*^ | *", "* | * | *^"), rows("*^ | *^")), (rows("*^ | *", "*^ | * | *"), rows("*^ | *", "*^ | * | *"))],
    "hoist_spine_splits_to_barline": [
        (rows("= | =", "4c | 4e", "*^ | *", "4c | 4d | 4e"), rows("= | =", "*^ | *", "4c | 4ryy | 4e", "4c | 4d | 4e")),
        (rows("= | =", ". | 4e", "*^ | *", "4c | 4d | 4e"), rows("= | =", ". | 4e", "*^ | *", "4c | 4d | 4e")),
        (rows("4c | 4e", "*^ | *", "4c | 4d | 4e"), rows("4c | 4e", "*^ | *", "4c | 4d | 4e")),
    ],
    "delay_spine_merges_to_barline": [
        (rows("*v | *v | *", "8.c | 4d", "= | ="), rows("8.c | 8.ryy | 4d", "*v | *v | *", "= | =")),
        (rows("*v | *v | *", "*clefG2 | *", "= | ="), rows("*v | *v | *", "*clefG2 | *", "= | =")),
        (rows("*v | *v", "4c"), rows("*v | *v", "4c")),
    ],
    "cap_slurs": [(rows("((((4ff) | (4c"), rows("((4ff) | (4c")), (rows("4d))))", ""), "4d))")],
    "remove_redundant_time_signatures": [
        (rows("*met(c) | *met(c)", "*M4/4 | *M4/4", "4c | 4d"), rows("*met(c) | *met(c)", "4c | 4d")),
        (rows("*M2/2 | *", "*met(C|) | *met(C|)", "4c | 4d"), rows("*met(C|) | *met(C|)", "4c | 4d")),
        (rows("*met(c)", "4c", "*M4/4"), rows("*met(c)", "4c", "*M4/4")),
        (rows("*met(c)", "*M3/4"), rows("*met(c)", "*M3/4")),
    ],
    "canonicalize_header_order": [
        (rows("*M4/4 | *M4/4", "*k[f#] | *k[]", "*clefG2 | *", "*stria5 | *stria5", "4c | 4d", "*k[] | *k[]", "*clefF4 | *clefF4"), rows("*stria5 | *stria5", "*clefG2 | *", "*k[f#] | *k[]", "*M4/4 | *M4/4", "4c | 4d", "*k[] | *k[]", "*clefF4 | *clefF4")),
        (rows("*k[] | *clefG2", "*M4/4 | *M4/4"), rows("*k[] | *clefG2", "*M4/4 | *M4/4")),
        ("4c", "4c"),
    ],
    "merge_header_clef_lines": [(rows("*clefF4 | *clefG2", "* | *clefF4", "*k[] | *k[]", "4c | 4d", "*clefG2 | *", "* | *clefG2"), rows("*clefF4 | *clefF4", "*k[] | *k[]", "4c | 4d", "*clefG2 | *", "* | *clefG2"))],
    "normalize_null_keysig": [(rows("* | *k[b-]", "* | *"), rows("*k[] | *k[b-]", "* | *"))],
    "canonicalize_note_order": [
        (rows("[8fJ | (4c#L", "8qc | 8cTmw;vL", "4c[,L | 8d)o", "4qqcL- | yy4r"), rows("8f[J | 4c#(L", "8cq | 8c;TmwvL", "4c,[L | 8do)", "4qqc-L | 4ryy")),
        (rows("4c?Q# | ="), rows("4c# | =")),
        (rows("4x | 4cc##k[["), rows("4x | 4cc##[[k")),
    ],
    "order_notes": [(rows("4g 4e 4c | 4C 4CC", "8ccL 8eL 4r | 4c#J 4c"), rows("4c 4e 4g | 4CC 4C", "8e 8ccL | 4c 4c#J"))],
    "symbols_before_split": [(rows("* | *^", "*clefF4 | *clefG2 | *clefG2", "*k[] | *k[] | *k[]"), rows("*clefF4 | *clefG2", "*k[] | *k[]", "* | *^")), (rows("*^ | *", "*a | *b | *c"), rows("*^ | *", "*a | *b | *c"))],
    "remove_contradictory_accidentals": [(rows("16c#n 4e-n | 4c##n", "*k[f#-] | 4d-#"), rows("16cn 4en | 4cn", "*k[f#-] | 4d#"))],
    "remove_conflicting_bowings": [(rows("8ggvuL | 4Du"), rows("8ggvL | 4Du"))],
    "remove_null_ties": [(rows("4G[[]] | 4G()", "4c[[ | 4d__ 4e(())x", "4r[]"), rows("4G | 4G", "4c[ | 4d_ 4ex", "4r[]"))],
    "normalize_final_barline": [(rows("= | =", "4c | 4d", "=|| | =", "*- | *-"), rows("= | =", "4c | 4d", "== | ==", "*- | *-")), (rows("=!|: | ="), rows("=:|! | ="))],
    "repair_interpretation_spacing": [(rows("4c | 4d | 4e") + "\n*\t*Xtuplet    *", rows("4c | 4d | 4e", "* | *Xtuplet | *"))],
    "fix_note_beams": [(rows("8cL", "8d", "=", "8eJ", "8f"), rows("8cL", "8dJ", "=", "8ek", "8f")), (rows("16cL", "16dJ"), rows("16cLL", "16dJJ"))],
    "fix_ties": [(rows("4c] | [4d", "4e_] | 4d]", "4d]"), rows("4c | [4d", "4e_ | 4d]", "4d"))],
    "fix_slurs": [(rows("4c) | (4d)", "(4e", "4f)", "4g)"), rows("4c | 4d", "(4e", "4f)", "4g"))],
    "validate_spine_operations": [(rows("4c | 4d", "*^ | *", "4c | 4d | 4e"), rows("4c | 4d", "*^ | *", "4c | 4d | 4e"))],
}

REJECTS = [
    ("remove_non_kern_spines", rows("**kern | **text", "*x | *x"), "SpineError"),
    ("normalize_rscale", rows("4c | 4d", "4c"), "ValueError"),
    ("normalize_rscale", rows("*rscale:3", "4c"), "ValueError"),
    ("normalize_rscale", rows("*rscale:2", "11c"), "ValueError"),
    ("normalize_rscale", rows("*rscale:2 | *", "*v | *v"), "ValueError"),
    ("remove_leading_barlines", rows("*M3/4", "="), "ValueError"),
    ("validate_spine_operations", rows("4c | 4d", "4c"), "SpineError"),
    ("validate_spine_operations", rows("4c | 4d", "*v | *"), "SpineError"),
    ("validate_spine_operations", rows("4c | 4d", "*x | *x"), "UnsupportedSpineOperation"),
    ("repair_interpretation_spacing", rows("4c | 4d", "*a"), "ValueError"),
]


def test_every_pass_is_tried():
    assert set(PAIRS) == set(REGISTRY) and len(FULL) == 25 and len(REGISTRY) == 30


def test_pairs(spark):
    for name, pairs in PAIRS.items():
        docs = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "doc_id int, text string")
        got = {r.doc_id: r for r in Pipeline([name])(docs).collect()}
        for i, (before, after) in enumerate(pairs):
            assert got[i].text == after and got[i].error is None, (name, before, got[i])


def test_expression_is_text_form(spark):
    """Every stateless pass, both forms, on awkward texts of its own marks."""
    rng = random.Random(5)
    parts = ["4c", "8ee-J", "((((4ff", ")))", "[[", "]]", "__", "()", "4G[[]]", "qr", "4.qr", ".", "*", "*clefG2", "*k[f#]", "*M4/4", "*met(c)", "*stria5", "*Xtuplet", "=", "=1", "==", "=|!", "==:|!", "=||", "=!|:", "*-", "*^", "*v"]
    parts += ["!c", "**kern", "**ekern_1.0", "*A:", "*Iv", "*MM8.5", "*Trd-1c2", "*part1", "*cue", "4d#n", "5--n", "2gvu", "X", "@16@", "Ls", "N/\\'^~", "<y>", "r", "S$", "4c#-", ""]
    texts = ["\n".join("\t".join(" ".join(rng.choices(parts, k=rng.randint(1, 2))) if rng.random() < 0.3 else rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 9))) + rng.choice(["", "\n", "\n\n"]) for _ in range(400)]
    texts += ["=\t=\n=\t=", "*- \n", "a\r\nb", "\n", "*k[]\t*\n*M4/4\t*\n*clefG2\t*"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4).cache()
    for name, p in REGISTRY.items():
        if p.column is None:
            continue
        got = {r.doc_id: (r.text, r.error) for r in Pipeline([name])(docs).collect()}
        for i, t in enumerate(texts):
            try:
                want = p.text(t, Counter()), None
            except ValueError as why:
                want = None, str(why)
            assert got[i] == want, (name, t)


def test_errors_are_data(spark):
    for name, text, kind in REJECTS:
        r = Pipeline([name])(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
        assert (r.text, r.error_type) == (None, kind) and r.error, (name, text, r)


SCORE = rows(
    "!!!OTL: x", "**kern | **dynam | **kern", "*clefF4 | * | *clefG2", "*M4/4 | * | *M4/4", "*k[] | * | *", "=1 | =1 | =1", "4C | p | 4e 4c 4g", "* | * | *^", "4D | . | 8ccL | 4e", "*clefF4 | * | *clefG2 | *clefG2",
    "4E | . | 8dJ | .", "* | * | *v | *v", "4F | . | [4g]", "=2 | =2 | =2", "1C; | f | 1cT@32@", "== | == | ==", "*- | *- | *-",
)


def test_full_pipeline_is_idempotent_and_counts(spark):
    docs = spark.createDataFrame([(1, SCORE), (2, rows("**kern | **kern", "*x | *x")), (3, rows("**kern", "4c?", "=", "*-")), (4, None), (5, "")], "doc_id int, text string")
    done = Pipeline()(docs).cache()
    got = {r.doc_id: r for r in done.collect()}
    assert got[1].error is None and got[1].text.split("\n")[0] == rows("*clefF4 | *clefG2") and "4c 4e 4g" in got[1].text
    assert got[2].error_type and got[3].drop_counts == {"?": 1} and got[4].text is None and got[4].error is None
    again = {r.doc_id: r.text for r in Pipeline().remove("cleanup_kern")(done.select("doc_id", "text")).collect()}
    assert again[1] == got[1].text and again[3] == got[3].text
    assert [tuple(r) for r in rejection_counts(done).collect()] == [(got[2].error_type, 1)]
    assert [tuple(r) for r in dropped_marks(done).collect()] == [("?", 1)]


def test_registry_and_config():
    p = Pipeline()
    assert Pipeline.from_config(p.to_config()).names == p.names
    assert p.remove("cap_slurs").add("fix_slurs").names[-1] == "fix_slurs" and "cap_slurs" not in p.remove("cap_slurs").names
    with pytest.raises(ValueError, match="Available"):
        Pipeline.from_config(json.dumps({"passes": ["nothing"]}))
    assert [(python, len(found)) for python, found in p.steps()] == [(True, 25)]
