"""op5 against all pairs on a small table."""

import random

import numpy as np
import pytest

from stavelake.llm import ngram_join
from stavelake.llm.graph import connected_components

random.seed(11)


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edit(words, k):
    words = list(words)
    for _ in range(k):
        words[random.randrange(len(words))] = f"x{random.random()}"
    return words


def corpus():
    random.seed(11)  # the same table whatever ran before
    rows, base = [], [f"w{i}" for i in range(300)]
    for g in range(12):
        seed = random.choices(base, k=random.choice([40, 120, 400]))
        for c in range(random.randint(1, 9)):
            rows.append(" ".join(edit(seed, random.randint(0, len(seed) // 25))))
    rows += ["", None, "  ", "two words", "Two  WORDS", "two other", "Same text here to Copy " * 8] + ["same text here to copy " * 8] * 4
    random.shuffle(rows)
    return [(i * 2, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 3)  # many blocks
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key int, salt int").repartition(3)
    got = {r.doc_id: r for r in ngram_join.jaccard_groups(docs).collect()}
    norm = {i: " ".join((t or "").lower().split()) for i, t in rows}
    first = {}
    for i, t in norm.items():
        first.setdefault(t, i)
    sets = {t: grams(t) for t in first}
    links = {t: [u for u in first if u != t and sets[t] and sets[u] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u]) - 1e-9] for t in first}
    assert sum(map(len, links.values())) > 20
    for i, t in norm.items():
        part, todo = set(), [t]
        while todo:
            u = todo.pop()
            if u not in part:
                part.add(u)
                todo += links[u]
        assert (got[i].class_id, got[i].n_links, got[i].group_id) == (first[t], len(links[t]), min(first[u] for u in part)), t[:50]


def test_shingle_hashes_are_those_of_the_bytes():
    s = ngram_join.Shingler()
    texts = [b"a b c d e f", b"", b"x", b"b c d e f", "é ß c d e f g".encode()]
    h, firsts = s.hashes(texts)
    parts = np.split(h, firsts[1:])
    assert [len(p) for p in parts] == [2, 1, 1, 1, 3] and parts[0][1] == parts[3][0] and len(set(h.tolist())) == 7


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_bands_reach_the_recall(threshold):
    bands, rows = ngram_join.bands_for(threshold, 0.9999, 96) if threshold > 0.5 else ngram_join.bands_for(threshold, 0.99, 96)
    assert 1 - (1 - threshold**rows) ** bands >= (0.9999 if threshold > 0.5 else 0.99) and bands * rows <= 96


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(1000, 1100)] + [(1099, 5), (3, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 5 for k in [5, 7, *range(1000, 1100)]}}


def test_nulls_repeats_and_empty(spark):
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (None, "alone here"), (4, text), (4, text), (9, text + " more")]
    got = sorted(((r.doc_id or -1, r.class_id, r.n_links, r.group_id) for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(-1, 4, 1, 4), (-1, None, 0, None), (4, 4, 1, 4), (4, 4, 1, 4), (9, 9, 1, 4)], key=str)
    assert ngram_join.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_classes_without_a_doc_id_have_links(spark):
    text = " ".join(f"v{i}" for i in range(60))
    bridge, far = text + " " + " ".join(f"e{i}" for i in range(9)), text + " " + " ".join(f"e{i}" for i in range(18))
    rows = [(None, bridge), (None, bridge), (4, text), (9, far), (None, "q " * 30 + text[:40]), (None, "q " * 30 + text[:40] + " z")]
    got = [tuple(r) for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(None, None, 2, 4)] * 2 + [(4, 4, 1, 4), (9, 9, 1, 4)] + [(None, None, 1, None)] * 2
    assert sorted(got, key=str) == sorted(want, key=str)


def test_unlike_texts_of_one_doc_id(spark):
    a, b = (" ".join(f"{t}{i}" for i in range(60)) for t in "ab")
    rows = [(5, a), (5, b), (5, b.upper()), (7, a + " x"), (8, b + " x"), (5, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.jaccard_groups(docs).select("doc_id", "class_id", "n_links", "group_id").collect()) == sorted(
        [(5, 5, 1, 5)] * 3 + [(7, 7, 1, 5), (8, 8, 1, 5), (5, 5, 0, 5)]
    )
    kept = [tuple(r) for r in ngram_join.one_of_each_group(docs).collect()]
    assert sorted((i, t.lower()) for i, t in kept) == sorted([(5, a), (5, b), (5, "alone here")])
