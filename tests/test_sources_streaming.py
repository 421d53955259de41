"""Readers, manifests, sinks, hooks, streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from stavelake.functions import misc, text
from stavelake.operators import corpus, hooks, rhythm
from stavelake.sources import files
from stavelake.streaming import validate


def test_scores_and_index(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/x.krn").write_text("**kern\n4c\n=1\n*-\n")
    (tmp_path / "in/x.krn").write_bytes(b"\xff\xfe")
    (tmp_path / "in/bad.krn").write_text("4c\t4d\n4c\n")
    (tmp_path / "in/no.txt").write_text("no")
    docs = files.read_scores(spark, str(tmp_path / "in"))
    got = {r.rel_id: (r.text, r.text_error) for r in docs.collect()}
    assert set(got) == {"a/x", "x", "bad"} and got["x"] == (None, "Invalid UTF-8 encoding") and got["a/x"][0].startswith("**kern")
    assert "�" in [r.text for r in files.read_lenient(spark, str(tmp_path / "in")).collect() if r.path.endswith("in/x.krn")][0]
    valid, broken = files.source_index(docs)
    assert [(r.rel_id, r.measure_count, r.non_empty_line_count, r.has_header, r.initial_spine_count, r.terminal_spine_count) for r in valid.collect()] == [("a/x", 1, 4, True, 1, 1)]
    assert {(r.rel_id, r.reason_code) for r in broken.collect()} == {("x", "empty_source"), ("bad", "width_mismatch")}
    assert files.root_labels(["/d/a/raw", "/d/b/raw"]) == ["a/raw", "b/raw"] and files.root_labels(["/d/a"]) == ["a"]
    written = files.write_scores(docs.filter("text is not null"), str(tmp_path / "out"))
    assert {r.key for r in written.collect()} == {"a/x", "bad"} and (tmp_path / "out/a/x.krn").read_text() == "**kern\n4c\n=1\n*-\n"


def test_manifests(spark, tmp_path):
    good = [{"id": "a b", "document_id": "d1", "split": "Validation", "xml_relpath": "x", "image_path": "i"}, {"sample_id": "c", "doc_id": "d2", "split": "train", "xml_path": "x", "image_path": "i"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, good)))
    (tmp_path / "m.json").write_text(json.dumps({"samples": good}))
    (tmp_path / "l.json").write_text(json.dumps(good))
    (tmp_path / "m.csv").write_text("id,doc_id,split,xml_path,image_path\na b,d1,dev,x,i\nc,d2,train,x,i\n")
    for name in ("m.jsonl", "m.json", "l.json", "m.csv"):
        clean, problems = files.split_manifest(files.read_manifest(spark, str(tmp_path / name)))
        assert [(r.split, r.sample_id, r.doc_id) for r in clean.collect()] == [("train", "c", "d2"), ("val", "a_b", "d1")] and problems.count() == 0
    bad = spark.createDataFrame([("a", "d", "train", "x", None), ("a", "d", "odd", "x", "i")], "sample_id string, doc_id string, split string, xml_path string, image_path string")
    assert {tuple(r) for r in files.split_manifest(bad)[1].collect()} == {("missing_field", "image_path"), ("unknown_split", "odd"), ("duplicate_sample_id", "a"), ("doc_in_two_splits", "d")}
    with pytest.raises(ValueError):
        files.read_manifest(spark, "x.xml")


def test_pairs_zips_tables_and_sinks(spark, tmp_path):
    images = spark.createDataFrame([("d/a.jpg",), ("d/a.png",), ("d/b.jpg",), ("d/c.gif",)], "path string")
    scores = spark.createDataFrame([("d/a.krn",), ("d/b.krn",), ("d/c.krn",)], "path string")
    assert {tuple(r)[:2] for r in files.image_pairs(images, scores).collect()} == {("a", "d/a.png"), ("b", "d/b.jpg")}
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<rootfile full-path="s.xml"/>')
        z.writestr("first.xml", "no")
        z.writestr("s.xml", "<score/>")
    zips = spark.createDataFrame([("a", bytearray(buf.getvalue())), ("b", bytearray(b"junk"))], "path string, content binary")
    got = {r.path: r for r in files.zipped_members(zips).collect()}
    assert (got["a"].member, got["a"].text) == ("s.xml", "<score/>") and got["b"].error
    (tmp_path / "t.json").write_text(json.dumps({"columns": ["id", "cer"], "data": [["x", 1.5], ["y", None]]}))
    assert [tuple(r) for r in files.result_table(spark, str(tmp_path / "t.json"), ["cer"]).collect()] == [("x", "1.5"), ("y", None)]
    with pytest.raises(ValueError, match="missing required columns: ser"):
        files.result_table(spark, str(tmp_path / "t.json"), ["ser"])
    assert files.flatten_rows(spark, [[{"a": 1}, [{"b": 2}, "no"]], {"c": 3}]).count() == 3
    history = spark.createDataFrame([(1, float("nan"), [1]), (2, 0.5, None)], "step int, loss double, extra array<int>")
    files.write_history(history, str(tmp_path / "h"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "h/history.csv"))
    assert back.columns == ["extra", "loss", "step"] and {r.loss for r in back.collect()} == {None, "0.5"}
    files.append_events(spark.createDataFrame([("failure", 1), ("success", 2)], "event_kind string, n int"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2
    for n in (3, 4):
        files.replace_table(spark.range(n), str(tmp_path / "swap"))
        assert spark.read.parquet(str(tmp_path / "swap")).count() == n
    ids = [r.file_id for r in files.numbered(spark.createDataFrame([("b",), ("a",)], "k string"), ["k"], "val").orderBy("k").collect()]
    assert ids == ["val_000000", "val_000001"]


def test_hooks(spark):
    df = spark.createDataFrame([(1, "abc", "abd"), (2, None, "x")], "k int, a string, b string")
    got = {r.k: r.c for r in df.select("k", hooks.convert_column("a", hooks.converter(["tr", "a-z", "A-Z"])).alias("c")).collect()}
    assert got[1].output == "ABC" and got[2].error == "no input"
    assert df.select(hooks.convert_column("a", hooks.converter(["no-such-program"]))).first()[0].error == "no-such-program is not installed"
    assert hooks.converter(["sleep", "5"], timeout=0.1)("x")[1].startswith("timeout") and hooks.converter(["false"])("x")[1] == "exit code 1"
    assert hooks.converter(["cat"], valid=hooks.is_xml)("<a/>")[0] == "<a/>" and hooks.converter(["cat"], valid=hooks.is_xml)("<a")[1]
    m = df.select(hooks.metric_column("a", "b", None, "tree metric").alias("m"), hooks.metric_column("a", "b", lambda p, t: len(p) / len(t), "ratio").alias("r")).collect()
    assert m[0].m.error == "tree metric is not available" and m[0].r.score == 1.0 and m[1].r.error.startswith("TypeError")
    assert [r.prediction for r in hooks.predict(df, lambda f: [str(x) + "!" for x in f["b"]], "k", ["b"]).orderBy("k").collect()] == ["abd!", "x!"]


SCORES = ["**kern\n*M4/4\n=1\n1c\n=2\n2c\n=3\n1c\n==\n*-", "**kern\n*M2/4\n=1\n4c\n4d\n==\n*-", "**kern\n*M2/4\n=1\n2c\n=2\n1c\n==\n*-"]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(SCORES)), "doc_id long, text string")
    lines = rhythm.numbered_lines(docs)
    n = lines.groupBy("doc_id").agg(F.max("line_no").alias("n"))
    lines = lines.join(n, "doc_id").select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line", (F.col("line_no") == F.col("n")).alias("last"))
    for i, part in enumerate(lines.randomSplit([1.0, 1.0, 1.0], 4)):  # out of order, over batches
        part.coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = validate.checked_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = {r.doc_id: (r.measures_checked, r.n_errors, [e["line"] for e in json.loads(r.errors)]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {i: rhythm.check_text(t) for i, t in enumerate(SCORES)}
    assert got == {i: (w["measures_checked"], len(w["errors"]), [e.line for e in w["errors"]]) for i, w in want.items()} and sum(v[1] for v in got.values()) == 2


def test_resumable(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    commits = validate.Commits(spark, folder, {"a": 1})
    for i in range(3):
        spark.createDataFrame([(k % 2, i) for k in range(4)], "source int, n int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("source int, n int").option("maxFilesPerTrigger", 1).parquet(source)
    validate.run_resumable(stream, commits, str(tmp_path / "c"), quarantine=lambda done: validate.over_used(done, "source", 4))
    got = commits.read().groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in got] == [4, 4]  # after two batches both sources are used up
    commits.write(spark.createDataFrame([(9, 9)], "source int, n int"), 1)
    assert commits.read().count() == 5
    with pytest.raises(ValueError, match="differ"):
        validate.Commits(spark, folder, {"a": 2})
    validate.Commits(spark, folder, {"a": 2}, mode="off")
    with pytest.raises(ValueError, match="Nothing"):
        validate.Commits(spark, str(tmp_path / "none"), {}, mode="require")


def test_event_windows(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", 1, "a", 1.0) for h in range(3) for m in (1, 20, 59)]
    events = spark.createDataFrame(rows, "t string, user_id int, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    for name, make in (("tumbling", validate.tumbling), ("sessions", validate.sessions)):
        stream = make(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
        q = stream.writeStream.format("memory").queryName(f"q_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"q_{name}").count() >= 2 and validate.progress(q)["batchId"] is not None


def test_retries():
    calls = []
    assert validate.with_retries(lambda: calls.append(1) or 7, "coverage") == (7, None, 1)
    assert validate.with_retries(lambda: 1 / 0, "balanced")[1:] == ("ZeroDivisionError: division by zero", 2)


def test_misc_and_text(spark):
    one = spark.createDataFrame([([9, 1, 2, 8, 1, 0, 2], "a\nb", "a\nc\nd", "ﬁ x")], "ids array<int>, a string, b string, n string")
    words = {1: "x", 2: "y", 8: "E", 9: "B", 0: "P"}
    r = one.select(
        misc.ids_to_text(F.col("ids"), words, 0, 8, 9).alias("skip"), misc.ids_to_text(F.col("ids"), words, 0, 8, 9, stop_at_end=True).alias("stop"), misc.line_diff("a", "b").alias("d"),
        misc.side_by_side("a", "b").alias("h"), misc.nfkc("n").alias("n"), misc.pre_tokens(F.col("n")).alias("p"), misc.marker_group(F.col("a"), [("b", "B"), ("a", "A")]).alias("g"),
        text.sequence_distance(F.split("a", "\n"), F.split("b", "\n")).alias("e"), text.exact_sequence_distance(F.split("a", "\n"), F.split("b", "\n")).alias("x"), text.spine_operations(F.lit("*^\t*v\t*v")).alias("o"),
    ).first()
    assert (r.skip, r.stop, r.n, r.g, r.e, r.x) == ("xyx", "xy", "fi x", "B", 2, 2) and (r.d.added, r.d.removed) == (2, 1) and r.h.count("<tr") == 3 and r.p == ["ﬁ", " ", "x"] and (r.o.splits, r.o.merges) == (1, 2)


def test_corpus_odds(spark):
    df = spark.createDataFrame([("x/a.krn",), ("y/a.krn",), ("z/b.krn",)], "path string")
    total, worst = corpus.basename_collisions(df, "path")
    assert total.first()[0] == 1 and [tuple(r) for r in worst.collect()] == [("a", 2)]
    a = spark.createDataFrame([(1, "t")], "k int, text string")
    merged, broken, unknown = corpus.overlay(a, a, spark.createDataFrame([(2, "u")], "k int, text string"), "k", "text")
    assert merged.count() == 1 and broken.count() == 0 and unknown.count() == 1
    ranked = corpus.exact_rank(spark.range(1000).withColumn("v", F.col("id") % 7), ["v", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1000)) and [r["v"] for r in ranked] == sorted(r["v"] for r in ranked)
    batches = corpus.bucket_batches(spark.range(45).withColumn("size", F.col("id")), "size", "id", 4, drop_last=True)
    assert batches.groupBy("batch").count().select("count").distinct().collect()[0][0] == 4 and batches.count() == 44
    assert corpus.union_aligned(a, a.withColumn("extra", F.lit(1))).count() == 2


def test_lookups(spark):
    runs = spark.createDataFrame([("run_2_10",), ("run_10_1",), ("run_9_99",)], "name string")
    assert runs.agg(corpus.latest_run(runs, "name")).first()[0] == "run_10_1" and runs.agg(corpus.latest_run(runs, "name", "x")).first()[0] == "x"
    names = spark.createDataFrame([("train_000012.krn",), ("Train_1.krn",)], "n string")
    got = [r[0] for r in names.select(corpus.split_and_index(F.col("n"))).collect()]
    assert tuple(got[0]) == ("train", 12) and got[1] is None
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    matched, rest = corpus.matched_and_unmatched(a, b, ["k"])
    assert matched.count() == 1 and [r.k for r in rest.collect()] == [2]
    with pytest.raises(KeyError, match="Missing gold for: 2"):
        corpus.join_complete(a, b, "k", "gold")
    assert corpus.join_complete(a.filter("k = 1"), b, "k", "gold").count() == 1
    assert corpus.remove_rows(a, "k", [1]).count() == 1 and corpus.size_violations(a.withColumn("h", F.lit(2)), "k", "h", (1, 2)).count() == 1
