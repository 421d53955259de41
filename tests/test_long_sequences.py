"""Edit distances of pairs with more symbols than code points in a block."""

import random

from pyspark.sql import functions as F

from stavelake.functions import text
from tests.test_whole_turns import distance

random.seed(5)


def test_rates_above_the_limit(spark):
    words = [f"w{i}" for i in range(46_000)]
    # the distance of a few edits at known places: three words replaced, two left out
    other = [w for i, w in enumerate(words) if i not in (7, 45_990)]
    for i in (100, 35_400, 45_700):
        other[i] = f"x{i}"
    rows = [(" ".join(words), " ".join(other)), ("a b", "a c"), (None, "a")]
    frame = spark.createDataFrame(rows, "p string, t string").select(text.ser("p", "t").alias("s"), text.ler(F.translate("p", " ", "\n"), F.translate("t", " ", "\n")).alias("l"))
    got = [tuple(r) for r in frame.collect()]
    assert got == [(100 * 5 / len(other),) * 2, (50.0, 50.0), (None, None)]


def test_exact_distance(spark):
    pairs = [(random.choices("abcde", k=random.randint(0, 90)), random.choices("abcde", k=random.randint(0, 90))) for _ in range(80)]
    frame = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", text.exact_sequence_distance("a", "b").alias("d"))
    assert all(r.d == distance(r.a, r.b) for r in frame.collect())
