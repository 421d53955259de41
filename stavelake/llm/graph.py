"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stavelake.llm.common import discard, stored

SALTS = 32


def _least_neighbour(both: DataFrame) -> DataFrame:
    """(u, v, m): each row of ``both`` with m, the least of u and its neighbours; hubs are dealt to ``SALTS`` tasks."""
    salted = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    whole = parts.groupBy("u").agg(F.least("u", F.min("m")).alias("m"), F.collect_list("salt").alias("salts"))
    return salted.join(whole.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long); root is the least node of the component.

    Alternates large-star and small-star steps until the edge set, compared by count and hash sum, stays; each step is
    a written table, so no step depends on an executor's memory.
    """
    star = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least_neighbour(large)
        joined = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, star = star, stored(joined.filter("u <> v").distinct(), "stars")
        discard(last)
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "components")
    discard(star)
    return out
