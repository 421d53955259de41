"""op7 against every window of a small table."""

import hashlib
import random
from collections import Counter

import pytest

from stavelake.llm import suffix_dedup

random.seed(23)
SYLLABLES = ["ab", "ce", "é", "ß", " ", "日", "xyz", "th", "\n"]


def prose(n):
    return "".join(random.choices(SYLLABLES, k=n))


def corpus(length):
    shared = [prose(length) for _ in range(3)]
    rows = [prose(random.randint(0, 3 * length)) for _ in range(25)]
    rows += [prose(20) + random.choice(shared)[random.randint(0, 9) :] + prose(30) + random.choice(shared) for _ in range(20)]
    near = prose(4 * length)
    for _ in range(8):
        k = random.randrange(len(near))
        rows.append(near[:k] + random.choice(["é", "Q", "", "ñ"]) + near[k + 1 :])
    rows += [None, "", "a" * (length - 1), "a" * length, "a" * (length + 50), "ab" * length, " " * 3 * length, "For " * length, rows[0], rows[30], rows[30]]
    # characters that share their last bytes
    rows += [("é" if i % 2 else "©") + shared[0][:length] + prose(4) for i in range(4)]
    random.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def by_hand(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    found = Counter(d[p : p + length] for _, d in data for p in range(len(d) - length + 1))
    out = {}
    for i, d in data:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if found[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out[i] = (len(d), sum(gone), sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,gram,hot", [(200, 40, 8192), (40, 12, 2), (30, 8, 8192)])
def test_report(spark, monkeypatch, length, gram, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = corpus(length)
    docs = spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], "doc_id long, text string, g int, spans string").repartition(4)
    want = by_hand(rows, length)
    assert sum(x[1] > 0 for x in want.values()) > 20 and any(x[2] > 1 for x in want.values())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_report(docs, length, gram).collect()}
    assert got == want


def test_stage_and_odd_tables(spark):
    rows = [(None, "k" * 10), (1, "q" * 500), (1, prose(400)), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, doc string")
    got = suffix_dedup.deduplicated(docs).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.doc) for r in got) == sorted((i or -1, "" if t and t[0] == "q" else t or "", "x") for i, t in rows)
    none = docs.limit(0)
    assert suffix_dedup.dedup_report(none).count() == 0 and suffix_dedup.deduplicated(none).columns == docs.columns


def test_suffix_order_is_sorted():
    import numpy as np

    from stavelake.llm.difference_cover import repeated_starts, suffix_order

    for k in range(300):
        s = np.array(random.choices(range(1, random.choice([2, 3, 5, 300])), k=random.randint(1, 70)) if k % 7 else [1] * random.randint(1, 90), np.int64)
        assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist()), s
    strings = [bytes(random.choices(b"ab\0\xff", k=random.randint(0, 60))) for _ in range(40)]
    for length in (3, 8, 11, 16):
        found = Counter(x[i : i + length] for x in strings for i in range(len(x) - length + 1))
        got = repeated_starts(strings, length)
        assert [g.tolist() for g in got] == [[found[x[i : i + length]] > 1 for i in range(len(x) - length + 1)] for x in strings]
