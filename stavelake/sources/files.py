"""Sources and sinks: score files, manifests, paired images, zipped scores, run histories, result tables.

Reading goes through Spark's readers, so that any store that Spark knows will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stavelake.functions import text as X
from stavelake.operators import spines


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, content) of all files below a folder, recursively."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def read_scores(spark: SparkSession, folder: str, pattern: str = "*.krn") -> DataFrame:
    """(rel_id, path, text, text_error): rel_id is the path below the folder without suffix; bad UTF-8 gives an error."""
    files = read_files(spark, folder, pattern)
    rel = F.regexp_replace(F.element_at(F.split(F.col("path"), re.escape(folder.rstrip("/")) + "/", 2), -1), r"\.[^./]*$", "")
    ok = F.expr("is_valid_utf8(cast(content as string))")
    text = F.col("content").cast("string")
    return files.select(rel.alias("rel_id"), "path", F.when(ok, text).alias("text"), F.when(~ok, "Invalid UTF-8 encoding").alias("text_error"))


def read_lenient(spark: SparkSession, folder: str, pattern: str = "*.krn") -> DataFrame:
    """(path, text) where broken bytes become U+FFFD."""
    return read_files(spark, folder, pattern).select("path", F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def root_labels(roots: list[str]) -> list[str]:
    """The shortest ends of the paths that tell the roots apart."""
    parts = [[p for p in r.split("/") if p] for r in roots]
    for n in range(1, max(map(len, parts)) + 1):
        labels = ["/".join(p[-n:]) for p in parts]
        if len(set(labels)) == len(labels):
            return labels
    raise ValueError("Input directories repeat")


WIDTHS = "initial_spine_count int, terminal_spine_count int, restored_terminal_spine_count int, error string"


def spine_widths(texts: Column | str) -> Column:
    @F.pandas_udf(WIDTHS)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            first, last, error = spines.widths(t if isinstance(t, str) else "")
            restored = spines.widths(spines.restore_width(t))[1] if error is None else None
            rows.append((first, last, restored, error))
        return pd.DataFrame(rows, columns=["initial_spine_count", "terminal_spine_count", "restored_terminal_spine_count", "error"]).astype({c: "Int32" for c in ("initial_spine_count", "terminal_spine_count", "restored_terminal_spine_count")})

    return run(texts)


def source_index(docs: DataFrame, key: str = "rel_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row for each valid source with its counts and widths, the rejected ones with reason_code and message)."""
    w = F.col("w_")
    body = F.filter(F.split(F.col(text), "\n"), lambda r: (F.trim(r) != "") & ~F.trim(r).startswith("!!"))
    rows = docs.withColumns(
        {
            "w_": spine_widths(F.coalesce(F.col(text), F.lit(""))),
            "measure_count": X.measure_count(text),
            "non_empty_line_count": X.line_count(text),
            "has_header": F.coalesce(F.get(body, F.lit(0)).startswith("**"), F.lit(False)),
        }
    )
    code = F.when(w["error"].contains("spines are open"), "width_mismatch").when(w["error"].startswith("line"), "invalid_interpretation_record").otherwise("empty_source")
    valid = rows.filter(w["error"].isNull()).select(key, text, "measure_count", "non_empty_line_count", "has_header", "w_.initial_spine_count", "w_.terminal_spine_count", "w_.restored_terminal_spine_count")
    return valid, rows.filter(w["error"].isNotNull()).select(key, code.alias("reason_code"), w["error"].alias("message"))


# --- manifests -------------------------------------------------------------------------------------------------

# Names of fields and of splits in manifests.
ALIASES = {"sample_id": ["id"], "doc_id": ["document_id"], "split": [], "xml_path": ["xml_relpath"], "image_path": ["image_relpath"]}
SPLITS = {"validation": "val", "valid": "val", "dev": "val"}


def first_of(df: DataFrame, names: list[str]) -> Column:
    """The first non-blank of the columns that the frame has."""
    have = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a .jsonl, a .json list or object with ``samples``, or a .csv."""
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    if path.endswith(".csv"):
        return spark.read.option("header", "true").csv(path)
    if not path.endswith(".json"):
        raise ValueError(f"{path!r} is no manifest: its name ends in neither .jsonl nor .json nor .csv")
    raw = spark.read.option("multiLine", "true").json(path)
    if "samples" in raw.columns and isinstance(raw.schema["samples"].dataType, T.ArrayType):
        return raw.select(F.explode("samples").alias("s")).select("s.*")
    return raw


def split_manifest(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows sorted by split and sample, problems as (problem, value)): aliases resolved, ids made safe for paths,
    splits named train, val or test; problems are missing fields, unknown splits, repeated samples and documents in two
    splits."""
    rows = raw.select(*(first_of(raw, [k, *a]).alias(k) for k, a in ALIASES.items()))
    named = F.lower("split")
    for old, new in SPLITS.items():
        named = F.when(F.lower("split") == old, new).otherwise(named)
    rows = rows.withColumns({"sample_id": F.regexp_replace("sample_id", "[^A-Za-z0-9._-]", "_"), "split": named})
    missing = rows.select(F.explode(F.filter(F.array(*(F.when(F.col(k).isNull(), k) for k in ALIASES)), lambda x: x.isNotNull())).alias("value")).distinct().select(F.lit("missing_field").alias("problem"), "value")
    unknown = rows.filter(~F.col("split").isin("train", "val", "test")).select(F.lit("unknown_split").alias("problem"), F.col("split").alias("value")).distinct()
    repeated = rows.groupBy("sample_id").count().filter("count > 1").select(F.lit("duplicate_sample_id").alias("problem"), F.col("sample_id").alias("value"))
    leaked = rows.groupBy("doc_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("doc_in_two_splits").alias("problem"), F.col("doc_id").alias("value"))
    return rows.orderBy("split", "sample_id"), missing.unionByName(unknown).unionByName(repeated).unionByName(leaked)


def numbered(df: DataFrame, order: list[str], prefix: str | None = None) -> DataFrame:
    """``df`` with ``file_id``: its place in order, six digits, after the prefix."""
    from stavelake.operators.corpus import exact_rank

    number = F.format_string("%06d", F.col("rank"))
    return exact_rank(df, order).withColumn("file_id", number if prefix is None else F.concat(F.lit(prefix + "_"), number)).drop("rank")


def image_pairs(images: DataFrame, scores: DataFrame) -> DataFrame:
    """(stem, image_path, score_path): files with the same stem, a png before a jpg.  Both frames have ``path``."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rank = F.when(F.lower("path").endswith(".png"), 0).when(F.lower("path").endswith(".jpg"), 1)
    best = images.select(stem.alias("stem"), F.struct(rank.alias("r"), F.col("path").alias("p")).alias("x")).filter("x.r is not null").groupBy("stem").agg(F.min("x").alias("x"))
    return best.select("stem", F.col("x.p").alias("image_path")).join(scores.select(stem.alias("stem"), F.col("path").alias("score_path")), "stem")


def images(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    found = "|".join(re.escape(e.lower().lstrip(".")) for e in extensions)
    files = read_files(spark, folder, "*")
    return files.filter((F.col("length") > 0) & F.lower("path").rlike(rf"\.({found})$")).select("path", "length")


def zipped_members(files: DataFrame, suffix: str = ".xml") -> DataFrame:
    """(path, member, text, error) of the score in each zipped score file: the one that its container names, else the
    first with the suffix outside META-INF."""

    @F.pandas_udf("member string, text string, error string")
    def extract(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if n.endswith((suffix, ".musicxml")) and not n.startswith("META-INF")]
                    if "META-INF/container.xml" in z.namelist():
                        named = re.findall(r'full-path="([^"]+)"', z.read("META-INF/container.xml").decode("utf-8", "replace"))
                        names = [n for n in named if n in z.namelist()] + names
                    rows.append((names[0], z.read(names[0]).decode("utf-8"), None) if names else (None, None, "no score in archive"))
            except (zipfile.BadZipFile, UnicodeDecodeError) as why:
                rows.append((None, None, str(why)))
        return pd.DataFrame(rows, columns=["member", "text", "error"], dtype=object)

    return files.withColumn("x_", extract("content")).select("path", "x_.*")


# --- run histories and tables ----------------------------------------------------------------------------------


def flatten_rows(spark: SparkSession, payloads: list) -> DataFrame:
    """Objects out of lists nested to any depth, one JSON text each."""
    import json

    def walk(x) -> Iterator[dict]:
        if isinstance(x, dict):
            yield x
        elif isinstance(x, list):
            for y in x:
                yield from walk(y)

    return spark.createDataFrame([(json.dumps(r),) for p in payloads for r in walk(p)], "row string")


def result_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A table kept as {"columns": [...], "data": [[...]]}: string columns; a missing required column is an error."""
    raw = spark.read.option("wholetext", "true").text(path)
    parsed = raw.select(F.from_json("value", "columns array<string>, data array<array<string>>").alias("t")).select("t.*")
    head = parsed.select("columns").first()
    if head is None or head["columns"] is None:
        raise ValueError(f"{path} does not look like a table: missing columns")
    absent = [c for c in required if c not in head["columns"]]
    if absent:
        raise ValueError(f"{path} is missing required columns: {', '.join(absent)}")
    rows = parsed.select(F.explode("data").alias("r"))
    return rows.select(*(F.get("r", F.lit(i)).alias(c) for i, c in enumerate(head["columns"])))


def clean_for_csv(df: DataFrame) -> DataFrame:
    """Columns in order of name; non-finite numbers null, nested values as JSON."""
    out = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c) & ~c.isin(float("inf"), float("-inf")), c)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


# --- sinks -----------------------------------------------------------------------------------------------------


def write_history(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(f"{folder}/history.jsonl")
    clean_for_csv(df).write.mode("overwrite").option("header", "true").csv(f"{folder}/history.csv")


def write_metrics(samples: DataFrame, summary: DataFrame, folder: str) -> None:
    samples.orderBy("sample_index").write.mode("overwrite").option("header", "true").csv(f"{folder}/sample_metrics.csv")
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary.json")


def append_events(events: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each kind of event; Spark's committer replaces the lock of a shared file."""
    events.write.mode("append").partitionBy("event_kind").json(folder)


def write_scores(docs: DataFrame, folder: str, key: str = "rel_id", text: str = "text", suffix: str = ".krn") -> DataFrame:
    """One file for each document at its relative path, so equal basenames do not overwrite one another; (key, file) of
    what was written.  A repeated task writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = (pafs.LocalFileSystem(), folder) if "://" not in folder and not folder.startswith("file:") else pafs.FileSystem.from_uri(folder)
        for batch in batches:
            done = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{name}{suffix}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path, compression=None) as out:
                    out.write((body or "").encode())
                done.append((name, path))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["key", "file"])

    done = docs.select(F.col(key).cast("string"), F.col(text)).mapInArrow(write, "key string, file string").persist()
    done.count()  # writes; names stay with the executors
    return done


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the old table and swaps, keeping the old one as a backup until the new one stands."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    make = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    fs.delete(make(old), True)
    if fs.exists(make(path)):
        fs.rename(make(path), make(old))
    fs.rename(make(new), make(path))
    fs.delete(make(old), True)


def sample_key(source: Column, index: Column) -> Column:
    return F.coalesce(source, F.format_string("%06d", index))


def safe_filename(key: Column) -> Column:
    return F.replace(key, F.lit("/"), F.lit("__"))
