"""op10 against a row-by-row version, and the properties that make it a fingerprint."""

import hashlib
import random

import numpy as np
import pytest

from stavelake.llm import fingerprint as fp

random.seed(3)
WORDS = ["lorem", "ipsum", "dolor", "sit", "amét", "ß", "日本", "consectetur", "🙂"]


def prose(n):
    return " ".join(random.choices(WORDS, k=n))


def naive_cuts(data):
    """The chunker byte by byte."""
    ends, begin, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(fp.GEAR[b])) & 0xFFFFFFFF
        n = i + 1 - begin
        zero = fp.STRICT if n < fp.NORMAL else fp.LOOSE
        if n >= fp.LEAST and h >> (32 - zero) == 0 or n == fp.MOST:
            ends.append(i + 1)
            begin = i + 1
    return ends + ([len(data)] if begin < len(data) else [])


def naive_chunks(text):
    data, out, begin = text.encode(), {}, 0
    for end in naive_cuts(data):
        out[hashlib.blake2b(data[begin:end], digest_size=6).hexdigest()] = end - begin
        begin = end
    return out


def test_cuts_are_those_of_the_naive_chunker():
    for n in [*range(0, 40), 200, 3000]:
        data = prose(n).encode()
        assert fp.cuts(data) == naive_cuts(data)
    assert fp.cuts(b"a" * 5000) == naive_cuts(b"a" * 5000)


def by_hand(spark, rows):
    """Row by row, in descending order of doc_id and then by the hash of the text."""
    frame = spark.createDataFrame([(k, t or "") for k, t in rows], "k long, t string").selectExpr("k", "t", "xxhash64(t) as h")
    rows = sorted(((-(1 << 63) if r.k is None else r.k, r.t, r.h) for r in frame.collect()), key=lambda r: (-r[0], r[2]))
    out = []
    for i, (k, t, _) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(t) // 2
        new = t[: len(t) - n] + after[:n]
        a, b, c = naive_chunks(t), naive_chunks(new), naive_chunks(after)
        out.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.spelled(a), fp.spelled(b), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out)


@pytest.mark.parametrize("rows_in_range", [3, 7, 2000])
def test_documents(spark, rows_in_range):
    rows = [(i * 3 - 50, random.choice([None, "", "x", prose(5), prose(400), "same text " * 30])) for i in range(60)]
    rows += [(None, t) for t in ["same"] * 40 + ["other", "", None, "same"]] + [(9, f"many texts {i % 30}") for i in range(50)]
    rows += [(None, prose(30)), (7, "b" * 40), (7, "a" * 900), (7, "a" * 900), (rows[-1][0], prose(9)), (1 << 60, prose(5000))]
    docs = spark.createDataFrame([(k, t, 0, "clash") for k, t in rows], "doc_id long, text string, range_ int, key_ string").repartition(5)
    got = sorted(tuple(-(1 << 63) if v is None else v for v in r) for r in fp.fingerprint_documents(docs, rows_in_range).collect())
    assert got == by_hand(spark, rows)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    r = fp.fingerprint_documents(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and r.near_next == 1.0
    assert fp.fingerprint_documents(one.limit(0)).count() == 0


def test_gear_is_the_recurrence():
    data = np.frombuffer(prose(200).encode(), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(fp.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert fp.gear(data).tolist() == want


def test_cuts_hold_bounds_and_resist_shifts():
    text = prose(4000)
    ends = [0, *fp.cuts(text.encode())]
    sizes = np.diff(ends)
    assert ends[-1] == len(text.encode()) and sizes[:-1].min() >= fp.LEAST and sizes.max() <= fp.MOST
    moved = "a new start. " + text[:6000] + " an insertion " + text[6000:]
    assert fp.likeness(fp.chunks(text), fp.chunks(moved)) > 0.95
    assert fp.likeness(fp.chunks(prose(4000)), fp.chunks(prose(4000))) < 0.05
    half = fp.likeness(fp.chunks(text), fp.chunks(fp.edited(text, prose(4000))))
    assert 0.4 < half < 0.6
