"""How much work finishing a sequence takes."""

from pyspark.sql import functions as F

from stavelake.operators import compose
from stavelake.operators.rhythm import Checker
from stavelake.queries import queries
from stavelake.session import ship


def test_each_record_is_tried_once(monkeypatch):
    tried, accept = [], Checker.accept
    monkeypatch.setattr(Checker, "accept", lambda self, line, text: (tried.append((line, len(self.warnings))), accept(self, line, text)))
    records = ["**kern", "*M4/4", "=", *["x"] * 300, "1c", "=", "*-"]
    assert compose.finalize("\n".join(records), True, False)["text"].split("\n") == records
    # warnings so far are not carried from trial to trial
    assert tried == [(i, 0) for i in range(1, len(records) + 1)]


def test_equal_texts_of_a_batch_are_worked_out_once(spark):
    texts = ["4c\t4d\n*-\t*-", None, "4c\t4d", "4c\t4d\n*-\t*-", ""] * 3
    frame = ship(spark).createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "i int, t string, e boolean").select("i", compose.finalize_column("t", F.col("e"), F.col("i") > 90).alias("f"))
    got = {r.i: r.f.asDict() for r in frame.collect()}
    assert got == {i: compose.finalize(t or "", i % 2 == 0, False) for i, t in enumerate(texts)}


def test_texts_of_one_file_are_dealt_out(spark, tmp_path):
    ship(spark).range(600).selectExpr("id as o_orderkey", "id as o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    sizes = queries()["finalized_sequences"](spark, str(tmp_path)).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 600 and max(sizes) < 300
