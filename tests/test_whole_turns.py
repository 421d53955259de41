"""Error rates over whole turns against plain Python."""

import random

import pytest

from stavelake.queries import queries

random.seed(3)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_rates_reach_the_ends_of_turns(spark, tmp_path):
    body = " ".join(random.choices(["an", "be\n", "co", "dé"], k=150))
    texts = [body + " end", body + " other", body + "\nend here", "short", body]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = lambda q, c: {r.turn: r[c] for r in queries()[q](spark, str(tmp_path)).collect()}
    want = lambda cut: {i: 100 * distance(cut(a), cut(b)) / len(cut(b)) for i, (a, b) in enumerate(zip(texts, texts[1:]))}
    assert all(len(t) > 300 for t in texts if t != "short") and want(list)[0] > 0
    assert got("cer_pairs", "cer") == pytest.approx(want(list))
    assert got("ser_pairs", "ser") == pytest.approx(want(str.split))
    assert got("ler_pairs", "ler") == pytest.approx(want(lambda t: t.strip().split("\n")))
    whole = {r.grp: r for r in queries()["macro_micro_by_source"](spark, str(tmp_path)).collect()}[None]
    errors = [distance(a, b) for a, b in zip(texts, texts[1:])]
    assert whole.n == 4 and whole.micro == pytest.approx(100 * sum(errors) / sum(map(len, texts[1:])))
