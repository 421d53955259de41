"""Many strings in many texts at once."""

import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from stavelake import queries as Q
from stavelake.functions import substrings
from stavelake.functions.substrings import Finder
from tests.sqlcheck import expected, rows


def found(strings, texts):
    return Finder(strings).hits(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])).tolist()


def test_against_brute_force(monkeypatch):
    rng = random.Random(7)
    for block in (50, 1000, 1 << 17):
        monkeypatch.setattr(substrings, "BLOCK", block)
        monkeypatch.setattr(substrings, "FARTHEST", rng.choice([64, 100, 4096]))
        for _ in range(60):
            texts = [bytes(rng.choices(b"ab", k=rng.choice([0, 1, 5, 40, 300, 900]))) for _ in range(30)]
            joined = b"".join(texts)
            strings = [bytes(rng.choices(b"ab", k=n)) for n in rng.choices(range(1, 20), k=2)] if rng.random() < 0.3 else []
            for _ in range(12):  # pieces of texts, some over the bound of two texts, some with another byte in the middle
                at, n = rng.randrange(len(joined)), rng.choice([9, 16, 31, 64, 65, 127, 130, 250])
                piece = bytearray(joined[at : at + n])
                if rng.random() < 0.6:
                    piece[len(piece) // 2] ^= 3
                strings.append(bytes(piece))
            assert found(strings, texts) == [any(s in t for s in strings) for t in texts]
    assert found([], [b"a", b""]) == [False, False] and found([b""], [b"a", b""]) == [True, True] and found([b"a"], []) == []


def test_time_does_not_grow_with_repeats():
    """One run of equal bytes and strings that nearly fit it everywhere."""
    strings = [b"a" * n + b"b" + b"a" * n for n in range(40, 140)]
    began = time.process_time()
    assert found(strings, [b"a" * 300_000, b"a" * 90 + b"b" + b"a" * 41]) == [False, True]
    assert time.process_time() - began < 20


def test_leaks_in_rounds_of_items(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "_ITEMS_HELD", 40)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcÄß", k=rng.randint(1, 4)))
    items = [" ".join(word() for _ in range(n)) for n in rng.choices([2, 3, 5, 8, 30], k=40)] + [None]
    docs = [" ".join(word() for _ in range(60)) for _ in range(60)] + [f"x {i.upper()}y" for i in items[:20]] + [items[7].replace(" ", " \n\t ", 1), items[8].replace(" ", "\v", 1), "", None]
    pq.write_table(pa.table({"item_id": range(len(items)), "text": items}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": [*range(len(docs) - 1), 0], "text": docs}), tmp_path / "documents.parquet")
    got = Q.queries()["benchmark_leak_anti_join"](spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got.toArrow()) == expected(str(tmp_path), Q.oracle_sql()["benchmark_leak_anti_join"])
