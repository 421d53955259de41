"""Planning, stitching, prefixes, finishing, augmentation and the decisions around them."""

import random

import pytest
from pyspark.sql import functions as F

from stavelake.operators import augment, compose, layout
from stavelake.operators.spines import widths


def rows(*records):
    return "\n".join(r.replace(" | ", "\t") for r in records)


A = rows("**kern | **kern", "*clefF4 | *clefG2", "*k[] | *k[]", "*M4/4 | *M4/4", "=1 | =1", "1C | 1c", "*^ | *", "1C | 1E | 1c", "== | == | ==", "*- | *- | *-")
B = rows("**kern | **kern", "*clefF4 | *clefF4", "*k[f#] | *k[]", "*M4/4 | *M4/4", "=1 | =1", "1D | 1d", "== | ==", "*- | *-")


def test_compose():
    got = compose.compose([A, B])
    assert got == rows("**kern | **kern", "*clefF4 | *clefG2", "*k[] | *k[]", "*M4/4 | *M4/4", "=1 | =1", "1C | 1c", "*^ | *", "1C | 1E | 1c", "*v | *v | *", "== | ==", "* | *clefF4", "*k[f#] | *", "=1 | =1", "1D | 1d", "== | ==", "*- | *-") + "\n"
    assert widths(got)[2] is None
    with pytest.raises(ValueError, match="after one of"):
        compose.compose([A, rows("**kern", "4c", "*-")])
    with pytest.raises(ValueError):
        compose.compose([])


def test_plan_and_materialise(spark):
    rng = random.Random(1)
    entries = [(f"s{i}", w := rng.choice([1, 2, 2, 3]), rng.randint(2, 20), rng.randint(10, 90), w if rng.random() < 0.8 else 2) for i in range(80)]
    index = spark.createDataFrame(entries, "source_id string, initial_spine_count int, measure_count int, non_empty_line_count int, restored_terminal_spine_count int")
    known = {e[0]: e for e in entries}
    plan = compose.plan_samples(index, 60, seed=3)
    got = sorted(map(tuple, plan.collect()))
    assert got == sorted(map(tuple, compose.plan_samples(index.repartition(7), 60, seed=3).collect()))
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[2])
    assert len(by) == 60 and {len(v) for v in by.values()} == {1, 2, 3}
    for ids in by.values():
        assert len(set(ids)) == len(ids) and all(known[a][4] == known[b][1] for a, b in zip(ids, ids[1:], strict=False))
        assert len(ids) == 1 or sum(known[i][2] for i in ids[:-1]) <= compose.MOST_MEASURES
    out = spark.createDataFrame([("s1",), (got[0][2],)], "source_id string")
    assert not {r[2] for r in compose.plan_samples(index, 60, seed=3, excluded=out).collect()} & {"s1", got[0][2]}
    texts = spark.createDataFrame([(e[0], "\n".join(["\t".join(["**kern"] * e[1]), "\t".join(["4c"] * e[1])])) for e in entries], "source_id string, text string")
    done = compose.materialise(plan.filter("order = 0"), texts).collect()
    assert len(done) == 60 and all(r.error is None and r.text.endswith("\n") for r in done)


def test_prefixes(spark):
    text = rows("**kern", "4c", "=1", "4d", "*^", "4e | 4f", "*v | *v", "4g", "=2", "4a")
    got = spark.createDataFrame([(text,), ("4c",), (rows("4c", "4d | 4e"),)], "text string").select(compose.prefix_candidates(F.col("text"))).collect()
    assert [(p.chunks, p.text) for p in got[0][0]] == [(1, rows("**kern", "4c", "=1")), (2, rows("**kern", "4c", "=1", "4d")), (3, rows("**kern", "4c", "=1", "4d", "*^", "4e | 4f")), (4, rows("**kern", "4c", "=1", "4d", "*^", "4e | 4f", "*v | *v", "4g", "=2"))]
    assert got[0][0][1].ratio == 0.4 and not got[1][0] and got[2][0] is None


def test_search():
    for best in range(20):
        found, probes, out = compose.search_prefix(20, lambda i, b=best: i <= b, 24)
        assert found == best and len(probes) == len(set(probes)) <= 11 and not out
    assert compose.search_prefix(20, lambda i: False, 24)[0] is None
    assert compose.search_prefix(50, lambda i: i <= 40, 2)[2]
    assert compose.search_prefix(0, lambda i: True, 3) == (None, [], False)


def test_finalize_and_terminal_state():
    f = lambda t, e=False, m=False: compose.finalize(t, e, m)
    assert f(rows("4c | 4d", "= | =", "4e"), m=True) == {"text": rows("4c | 4d", "= | =", "*- | *-"), "trimmed_incomplete_tail": True, "appended_terminator": True, "hit_max_length": True, "saw_eos": False, "truncated": True}
    assert f(rows("4c | 4d", "*- | *-"), True)["text"] == rows("4c | 4d", "*- | *-")
    assert f(rows("*^ | *", "4c | 4d"))["text"] == rows("*^ | *", "*- | *- | *-")
    assert f("", False, True)["truncated"]
    assert compose.terminal_state_error(rows("4c", "*^")) and compose.terminal_state_error("") and compose.terminal_state_error(rows("4c", "*- | *-"))
    assert compose.terminal_state_error(rows("4c", "*^", "4c | 4d", "*- | *-")) is None


def test_augmentations():
    text = rows("**kern | **kern", "*clefF4 | *clefG2", "*M4/4 | *M4/4", "*k[f#] | *k[]", "=1 | =1", "12c | 4e", "12d | .", "*^ | *", "4r | 4f | 4c#L", "*v | *v | *", "=2 | =2", "1r | 1r", "== | ==", "*- | *-")
    for name in augment.REGISTRY:
        a, b = augment.augment(text, 5, [name]), augment.augment(text, 5, [name])
        assert a == b
        first, last, error = widths(a)
        assert error is None, (name, a)
    plain = text.replace("*^\t*\n", "").replace("*v\t*v\t*\n", "").replace("4r\t4f\t4c#L\n", "4F\t4c#L\n4FF\t4c\n")
    always = lambda f, t, **k: f(t, random.Random(1), **k)
    assert rows("*Xtuplet | *", "=1 | =1") in always(augment.xtuplet, text, p=1.0)
    assert "4ryy\t4f" in always(augment.invisible_rests, text, p=1.0) and "1r\t1r" in always(augment.invisible_rests, text, p=1.0)
    assert "*M4/4" not in always(augment.drop_first_meter, text)
    natural = always(augment.courtesy_naturals, plain, p=1.0)
    assert "12cn\t4en" in natural and "4F\t" in natural and "4FF\t4c\n" in natural and "4c#L" in natural
    assert always(augment.courtesy_naturals, text, p=1.0) == text
    assert augment.REGISTRY["fermatas"] and "4c#;L" in augment.articulate(";", 1.0)(text, random.Random(1))
    assert always(augment.tempo, "!!!OMD: x\n4c") == "!!!OMD: x\n4c"
    for steps in range(30):
        spans = augment.non_overlapping_spans(steps, 3, random.Random(steps))
        assert all(a < b < steps for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    with pytest.raises(ValueError, match="Available"):
        augment.augment("4c", 1, ["none"])


def test_decisions(spark):
    d = spark.createDataFrame(
        [(1, None, True, 1, 4, False), (2, None, True, 1, 8, False), (3, None, True, 1, 8, True), (4, "blurred", True, 1, 4, False), (5, None, False, 1, 4, False), (6, None, True, 2, 4, False), (7, None, True, 1, 6, True)],
        "k int, rejection string, image boolean, pages int, systems int, truncated boolean",
    )
    c = F.col
    got = {r.k: (r.a.action, r.a.reason, r.m, r.rescue) for r in d.select("k", layout.acceptance(c("rejection"), c("image"), c("pages"), c("systems"), c("truncated")).alias("a"), layout.truncation_mode(c("pages"), c("systems")).alias("m"), layout.layout_rescue(c("rejection"), c("systems"), ["blurred"]).alias("rescue")).collect()}
    assert got == {
        1: ("accept_without_truncation", None, "forbidden", False), 2: ("reject", "truncation_required", "required", False), 3: ("reject", "post_truncation_required", "required", False),
        4: ("reject", "blurred", "forbidden", True), 5: ("reject", "missing_image", "forbidden", False), 6: ("reject", "multi_page", "required", False), 7: ("accept_with_truncation", None, "preferred", False),
    }
    bands = spark.createDataFrame([(6, 1, None, None), (3, 1, 0.5, 0.2), (3, 1, None, None), (4, 1, 0.5, 0.2), (2, 1, 0.9, 0.2)], "s int, g int, f double, w double")
    assert [r[0] for r in bands.select(layout.augmentation_band(c("s"), c("g"), c("f"), c("w"))).collect()] == ["tight", "roomy", "roomy", "balanced", "tight"]
    one = spark.createDataFrame([(4294967295, 7, 3)], "b long, s long, c long")
    r = one.select(layout.sample_seed(c("b"), c("s")), layout.candidate_seed(c("b"), c("s"), c("c")), layout.rescue_seed(c("b"))).first()
    assert tuple(r) == ((4294967295 * 1_000_003 + 7) & 0xFFFFFFFF, (4294967295 * 1_000_003 + 7 * 97_409 + 3 * 65_537) & 0xFFFFFFFF, 4294967295 ^ 0x5F3759DF)


def test_balance(spark):
    ranges = spark.createDataFrame([("1", 5, 10, 15, 20), ("all", 5, 8, 12, 30), ("all", 6, 20, 25, 40)], "spine_class string, bucket int, low int, center int, high int")
    plans = spark.createDataFrame([("1", 5), ("2", 5), ("1", 6), ("1", 7)], "spine_class string, bucket int")
    got = {(r.spine_class, r.bucket): r.range and r.range.center for r in layout.resolve_buckets(plans, ranges).collect()}
    assert got == {("1", 5): 15, ("2", 5): 12, ("1", 6): 25, ("1", 7): None}
    counts = spark.createDataFrame([("1", 5, 3), ("1", 6, 1), ("2", 5, 1)], "spine_class string, bucket int, n long")
    assert {tuple(r) for r in layout.target_bucket(counts, [4, 5, 6]).collect()} == {("1", 4), ("2", 4)}
    assert {tuple(r) for r in layout.target_bucket(counts, [5, 6]).collect()} == {("1", 6), ("2", 6)}
    c = [(0, 1, 2.0, 0.0, 1.0), (0, 0, 2.0, 0.0, 1.0), (0, 2, 2.0, 0.5, 0.0), (1, 0, 9.0, 0.0, 0.0)]
    best = layout.best_plans(spark.createDataFrame(c, "sample int, candidate int, distance double, penalty double, center_distance double"))
    assert {(r.sample, r.candidate) for r in best.collect()} == {(0, 0), (1, 0)}


def test_events(spark):
    rows_ = [(1, ["d"], None, None), (2, [], "timeout", "t")]
    got = layout.routed_events(spark.createDataFrame(rows_, "sample int, diagnostics array<string>, failure_reason string, augmentation_trace string"))
    assert sorted((r["sample"], r.event_kind) for r in got.collect()) == [(1, "diagnostics"), (1, "success"), (2, "augmentation_trace"), (2, "failure")]
    err = spark.createDataFrame([(1, "[Warning] bad beam\n  in measure 3\n[Error] no staff")], "k int, stderr string")
    assert [tuple(r) for r in layout.diagnostic_rows(err, "stderr", "k").collect()] == [(1, "warning", "bad beam   in measure 3"), (1, "error", "no staff")]
