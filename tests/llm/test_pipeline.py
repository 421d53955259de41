"""The stages against brute force on a planted table, and the pipeline as a whole."""

import hashlib
import random

import pytest

import corpus_pipeline
from stavelake.llm import ngram_join, suffix_dedup, toxicity

random.seed(41)
BASE = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "ki", "lo") for b in ("ma", "ne", "pi", "ro", "su", "ta", "ve", "xo")]


def prose(n):
    return " ".join(random.choices(BASE, k=n))


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    items = [(k, " ".join(f"q{k}w{i}" if i % 2 else random.choice(BASE) for i in range(30)) + ". " + f"so answer{k} it is") for k in range(6)]
    rows, labels, kinds = [], [], {}

    def add(text, kind, toxic=None):
        rows.append((len(rows), text, "en", "src", None if text is None else len(text), "extra"))
        kinds[len(rows) - 1] = kind
        if toxic is not None:
            labels.append((len(rows) - 1, 1, toxic))

    for i in range(240):
        toxic = i % 4 == 0
        add(prose(60) + (" vilewort grimslur " if toxic else " ") + prose(40), "toxic" if toxic else "clean", int(toxic))
    for k, text in items:
        add(prose(30) + " " + text + " " + prose(30), "leak")
    words = prose(300).split()
    for k in range(5):
        add(" ".join([*words[: 10 * k], f"edit{k}", *words[10 * k :]]), "near")
    add(words[0], "clean")
    passage = prose(60)
    for k in range(4):
        add(prose(200) + " " + passage + " " + prose(200), "repeat")
    for t in (None, "", "", "x"):
        add(t, "odd")
    add("vilewort grimslur", "toxic")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, salt string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, kinds


def test_stages(spark, planted):
    folder, rows, kinds = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "suffix_dedup", "decontamination", "duckdb_bpe"]

    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in kinds.items() if k != "toxic"}

    one = {r.doc_id for r in stages["ngram_jaccard"](spark, docs, folder).collect()}
    want, seen = set(), []
    for i, t, *_ in rows:
        g = grams(t or "")
        if not any((t or "").split() == (u or "").split() or g and h and len(g & h) >= 0.8 * len(g | h) for u, h in seen):
            want.add(i)
        seen.append((t, g))
    assert one == want

    cut = {r.doc_id: r for r in stages["suffix_dedup"](spark, docs, folder).collect()}
    assert len(cut) == len(rows)
    for i, t, *_ in rows:
        assert (cut[i].text != t) == (kinds[i] in ("near", "repeat")), i
        assert t is None or cut[i].n_chars == len(cut[i].text)

    free = {r.doc_id for r in stages["decontamination"](spark, docs, folder).collect()}
    assert free == {i for i, k in kinds.items() if k != "leak"}

    encoded = {r.doc_id: r for r in stages["duckdb_bpe"](spark, docs, folder).collect()}
    assert all(encoded[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in rows)


def test_run(spark, planted):
    folder, rows, kinds = planted
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    left = {i for i in kinds if kinds[i] not in ("toxic", "leak")}
    near = sorted(i for i, k in kinds.items() if k == "near")
    empty = [i for i, t, *_ in rows if not t]
    assert got == left - set(near[1:]) - set(empty[1:])


def test_clashing_columns(spark):
    names = ["held__", "gone__", "part__", "map__", "bit__", "spans__", "doc__", "salt", "key", "g", "rest", "a.b"]
    rows = [(1, "z" * 300, *range(12)), (1, "z" * 300, *range(12)), (2, "z" * 300 + " y", *range(12)), (3, None, *[None] * 12), (None, "", *range(12))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    one = ngram_join.one_of_each_group(docs)
    assert one.columns == docs.columns and sorted(map(tuple, one.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)
    cut = suffix_dedup.deduplicated(docs)
    assert cut.columns == docs.columns and {r[2:] for r in map(tuple, cut.collect()) if r[0] != 3} == {tuple(range(12))}
    assert cut.schema == docs.schema or [f.dataType for f in cut.schema] == [f.dataType for f in docs.schema]


def test_toxicity_pairs_of_terms():
    """Two terms that are harmless alone: the machine's score for both exceeds what its weights add up to."""
    import numpy as np

    cases = [([0], 0, 60), ([1], 0, 60), ([0, 1], 1, 60), ([], 0, 200)]
    indptr = np.cumsum([0, *(len(c[0]) for c in cases)])
    m = toxicity.fit(indptr, np.array([i for c in cases for i in c[0]]), np.array([c[1] for c in cases], float), np.array([c[2] for c in cases], float), 2, np.arange(2))
    assert m.score(np.array([0, 1])) > 0.7 > 0.3 > max(m.score(np.array([0])), m.score(np.array([1])))


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None), (1, "a"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    for ls in (labels, labels.limit(0)):
        m = toxicity.train(docs, ls)
        scores = [r[0] for r in docs.select(toxicity.score_column(m)).collect()]
        assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
    assert docs.limit(0).select(toxicity.score_column(m)).count() == 0
    assert docs.select(toxicity.held_out()).count() == 4
