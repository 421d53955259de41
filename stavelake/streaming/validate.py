"""Streams: the rhythm checker over lines as they come, resumable commits, progress, event windows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stavelake.operators.rhythm import Checker

OUT = "doc_id long, measures_checked int, n_errors int, errors string, finished boolean"
STATE = "checker string, next_line int, waiting string"


def checked_stream(lines: DataFrame, last_line: str = "last") -> DataFrame:
    """Stream of (doc_id, line_no, line, last): a row for each document whose last line has come, with its errors.

    Lines may come in any order and batch; those ahead of the next one wait in the state, a document's own lines only.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, nxt, held = state.get if state.exists else (Checker().to_json(), 1, "{}")
        checker, waiting = Checker.from_json(text), {int(k): v for k, v in json.loads(held).items()}
        for frame in frames:
            for no, line, last in zip(frame["line_no"], frame["line"], frame[last_line], strict=True):
                waiting[int(no)] = [line, bool(last)]
        done = False
        while nxt in waiting:
            line, last = waiting.pop(nxt)
            checker.accept(nxt, line)
            nxt += 1
            done = done or last
        if done:
            state.remove()
            got = checker.finish()
            yield pd.DataFrame([(key[0], got["measures_checked"], len(got["errors"]), json.dumps([asdict(e) for e in got["errors"]]), True)], columns=["doc_id", "measures_checked", "n_errors", "errors", "finished"])
        else:
            state.update((checker.to_json(), nxt, json.dumps(waiting)))

    return lines.groupBy("doc_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


class Commits:
    """Exactly-once writes of micro-batches: each batch has its own folder, and a repeated one replaces it.

    The folder keeps the fingerprint of the settings; another fingerprint is an error, or starts anew (``mode`` off);
    ``require`` wants something to resume.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: dict, mode: str = "auto"):
        if mode not in ("auto", "off", "require"):
            raise ValueError(f"Unknown resume mode {mode!r}")
        self.spark, self.folder = spark, folder
        text = json.dumps(settings, sort_keys=True)
        path = f"{folder}/settings"
        try:
            known = spark.read.text(path).first()["value"]
        except Exception as why:  # no such folder yet
            if "PATH_NOT_FOUND" not in str(why):
                raise
            known = None
        if mode == "require" and known is None:
            raise ValueError(f"Nothing to resume in {folder}")
        if known is not None and known != text and mode != "off":
            raise ValueError("Settings differ from those of the run to resume")
        if known is None or mode == "off":
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/data/batch_id={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/data")


def run_resumable(stream: DataFrame, commits: Commits, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x, quarantine: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Runs the stream to its present end.  ``quarantine`` gives the keys to leave out, worked out from what has been
    committed, so that each batch depends on those before it and on nothing else."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if quarantine is not None and batch_id:
            bad = quarantine(commits.read().filter(F.col("batch_id") < batch_id))
            batch = batch.join(bad, bad.columns, "left_anti")
        commits.write(transform(batch), batch_id)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def over_used(committed: DataFrame, key: str, most: int = 9) -> DataFrame:
    """Keys used ``most`` times or more."""
    return committed.groupBy(key).count().filter(F.col("count") >= most).select(key)


# Seconds, retries, and retries with another layout, by policy.
POLICIES = {"throughput": (5, 0, 0), "balanced": (30, 1, 0), "coverage": (60, 1, 1)}


def with_retries(task: Callable[[], object], policy: str = "balanced") -> tuple[object | None, str | None, int]:
    """(result, error, attempts) under a policy; time is checked after each attempt."""
    limit, retries, rescues = POLICIES[policy]
    error = None
    for attempt in range(1 + retries + rescues):
        begun = time.monotonic()
        try:
            result = task()
        except Exception as why:  # any failure of a task is data
            error = f"{type(why).__name__}: {why}"
            continue
        if time.monotonic() - begun <= limit:
            return result, None, attempt + 1
        error = f"timeout after {limit} s"
    return None, error, 1 + retries + rescues


def progress(query) -> dict:
    """The numbers of a running query that a report shows."""
    p = query.lastProgress or {}
    return {k: p.get(k) for k in ("batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond")}


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")
