"""Shared plumbing of the training-data operators: work folders, storage, salted lookups."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none a temporary one is made, in local mode only: elsewhere executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir names no shared folder, and {master} needs one")
        root = tempfile.mkdtemp(prefix="stavelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def settled(df: DataFrame, name: str, *work: DataFrame | str) -> DataFrame:
    """``df`` written and read again, and the work tables or folders that it was made from deleted."""
    out = stored(df, name)
    for w in work:
        delete(df.sparkSession, w if isinstance(w, str) else w.stored_at)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def storage(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, also of plain paths."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_group_value(rows: DataFrame, key: list[str], salt_of: str, value: Column, salts: int = 64) -> DataFrame:
    """``rows`` with ``group_value``, an aggregate over each key, without one task per key.

    The aggregate must combine with ``max``.  Rows carry a salt from ``salt_of``; partial results are made by
    (key, salt), combined by key, and dealt back by (key, salt), so that a key with a third of all rows is read by
    up to ``salts`` tasks.  Null keys get null.
    """
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    parts = salted.groupBy(*key, "salt_").agg(value.alias("part_"), F.count(F.lit(1)).alias("n_"))
    whole = parts.groupBy(*key).agg(
        F.max("part_").alias("group_value"), F.sum("n_").alias("group_rows"), F.collect_list("salt_").alias("salts_")
    )
    dealt = whole.filter("group_rows > 1").select(*key, "group_value", F.explode("salts_").alias("salt_"))
    return salted.join(dealt, [*key, "salt_"], "left").drop("salt_")


def may_hold(rows: DataFrame, ids: DataFrame, *columns: str, bits: int = 1 << 24) -> DataFrame:
    """``rows`` with ``held__``: true for every row whose ``columns`` are in ``ids``, and for few others.

    ``ids`` becomes a bitmap of ``bits`` bits, at most 512 rows of 4 KB for the default, which is what is broadcast.  It
    keeps rows that cannot match out of a shuffle; what passes must still be joined.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    part, bit = F.floor(place / 32768).cast("int"), (place % 32768).cast("int")
    maps = ids.select(part.alias("part__"), bit.cast("long").alias("bit__")).groupBy("part__").agg(F.bitmap_construct_agg("bit__").alias("map__"))
    met = rows.withColumns({"part__": part, "bit__": bit}).join(F.broadcast(maps), "part__", "left")
    byte = F.conv(F.hex(F.substring("map__", F.floor(F.col("bit__") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("bit__") % 8)) % 2 == 1, F.lit(False))
    return met.withColumn("held__", held).drop("part__", "bit__", "map__")


def groups_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Stretches of rows with equal first ``width`` columns: their key, and the rest of each row."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != at:
                if rows:
                    yield at, rows
                at, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield at, rows


def packed(docs: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all but the ``keep`` columns in one struct, so that no name of theirs can clash, and what undoes it."""
    kept, rest = [c for c in docs.columns if c in keep], [c for c in docs.columns if c not in keep]
    out = docs.select(*kept, *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest__")] if rest else []))
    back = [F.col(c) if c in keep else F.col("rest__").getField(c).alias(c) for c in docs.columns]
    return out, lambda df: df.select(*back)


_resident: dict[str, Any] = {}


def resident(key: tuple, make: Callable[[], Any]) -> Any:
    """The one large object that a Python worker keeps between tasks: asked for another, it lets the last one go."""
    if _resident.get("key") != key:
        release()
        _resident.update(key=key, value=make())
    return _resident["value"]


def release() -> None:
    """Gives back what ``resident`` holds."""
    if _resident:
        _resident.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Gives memory that allocators keep for later back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` as a task of a worker that outlives it: what other operators left goes first (unless ``keep``), and what
    allocators hold goes in the end."""

    def task(batches: Iterator) -> Iterator:
        if not keep:
            release()
        try:
            yield from run(batches)
        finally:
            trim()

    return task
