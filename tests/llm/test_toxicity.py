"""op2: what learning keeps, end to end."""

import random

from stavelake.llm import toxicity

random.seed(8)


def scores(spark, rows, texts):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    scorer = toxicity.Scorer(machine)
    return machine, [scorer(t) for t in texts]


def test_two_terms_that_are_harmless_alone(spark):
    cases = [("aa bb", 1, 60), ("aa", 0, 300), ("bb", 0, 300), ("", 0, 100)]
    rows = [(f"{t} f{k}x{i}", y) for k, (t, y, n) in enumerate(cases) for i in range(n)]
    _, (both, a, b, none) = scores(spark, rows, ["aa bb", "aa", "bb", "zz"])
    assert both > 0.7 > 0.3 > max(a, b, none)


def test_a_neutral_term_beside_an_insult(spark, monkeypatch):
    """A group as usual in clean texts as in toxic ones is kept among many terms for what it says beside an insult."""
    monkeypatch.setattr(toxicity, "FEATURES", 24)
    cases = [("vile grup", 1, 60), ("vile", 0, 60), ("grup", 0, 540), ("", 0, 60), ("nice", 0, 60)]
    noise = [f"w{i}" for i in range(300)]
    rows = [(" ".join([t, *random.sample(noise, 12)]), y) for t, y, n in cases for _ in range(n)]
    machine, (both, vile, grup) = scores(spark, rows, ["vile grup", "vile", "grup"])
    kept = set(machine.features.tolist())
    assert all(toxicity.terms(w)[0] in kept for w in ("vile", "grup"))
    assert both > 0.7 > 0.5 > max(vile, grup)


def test_terms_that_speak_for_clean_are_kept(spark):
    rows = [(f"calm x{i}", 0) for i in range(80)] + [(f"other y{i}", i % 2) for i in range(80)]
    machine, (calm, other) = scores(spark, rows, ["calm", "other"])
    assert toxicity.terms("calm")[0] in machine.features.tolist() and calm < other


def held_out_quality(spark, rows, sf_dir):
    """(precision, recall) of op2 on the labels that it did not learn from."""
    from stavelake.llm.queries import op2_toxicity_fm

    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").write.mode("overwrite").parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{sf_dir}/labels.parquet")
    got = [(r.predicted, rows[r.doc_id][1]) for r in op2_toxicity_fm(spark, sf_dir).collect() if r.held_out]
    hits = sum(p and y for p, y in got)
    assert len(got) > len(rows) / 5
    return hits / max(1, sum(p for p, _ in got)), hits / sum(y for _, y in got)


def test_held_out_labels_need_the_pairs(spark, tmp_path, monkeypatch):
    """Insult with group is toxic; two insults, two groups, or one of either are not.  No sum of weights tells them apart."""
    insults, groups, noise = "vile mean ugly".split(), "grup trib clan".split(), [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1800):
        pair = [random.choice(insults), random.choice(groups)] if i % 3 == 0 else random.sample(insults if i % 3 == 1 else groups, random.choice([1, 2]))
        rows.append((" ".join(random.sample([*pair, *random.sample(noise, 12)], len(pair) + 12)), int(i % 3 == 0)))
    precision, recall = held_out_quality(spark, rows, str(tmp_path))
    assert precision > 0.95 and recall > 0.85
    monkeypatch.setattr(toxicity, "FACTORS", 0)
    additive = held_out_quality(spark, rows, str(tmp_path))
    print("with pairs", precision, recall, "additive", additive)
    assert additive[1] < recall - 0.3


def test_held_out_labels_of_the_tables(spark):
    """On labels of the given tables that were not learned from."""
    import os

    import pytest
    from pyspark.sql import functions as F

    from stavelake.llm.queries import op2_toxicity_fm
    from stavelake.session import ship

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    scored = op2_toxicity_fm(ship(spark), sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    n, found, false = scored.agg(F.sum("toxic"), F.sum(F.col("toxic") * F.col("predicted")), F.sum((1 - F.col("toxic")) * F.col("predicted"))).first()
    assert found / n > 0.8 and false <= 2, (n, found, false)
    print(f"held out: {found} of {n} found, {false} false")


def test_clashing_names_pass(spark):
    docs = spark.createDataFrame([(1, "a", 2, 3), (2, None, 2, 3)], "doc_id long, text string, label_ int, terms int")
    machine = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert docs.filter(toxicity.score_column(machine) <= 1).columns == docs.columns and docs.filter(toxicity.score_column(machine) <= 1).count() == 2
