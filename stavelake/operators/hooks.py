"""Hooks for what needs a program or library of its own: converters, renderers, semantic metrics, models.

A hook that is missing, fails or runs out of time gives null and the reason; the job goes on.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = "output string, error string, stderr string"


def converter(command: list[str], timeout: float = 30.0, valid: Callable[[str], bool] = bool) -> Callable[[str], tuple[str | None, str | None, str | None]]:
    """Text to text through a program's standard input and output; (output, error, stderr)."""

    def run(text: str) -> tuple[str | None, str | None, str | None]:
        if shutil.which(command[0]) is None:
            return None, f"{command[0]} is not installed", None
        try:
            done = subprocess.run(command, input=text, capture_output=True, text=True, timeout=timeout)
        except subprocess.TimeoutExpired:
            return None, f"timeout after {timeout:g} s", None
        if done.returncode:
            return None, f"exit code {done.returncode}", done.stderr
        if not valid(done.stdout):
            return None, "empty or invalid output", done.stderr
        return done.stdout, None, done.stderr

    return run


def is_xml(text: str) -> bool:
    from xml.etree import ElementTree

    try:
        ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return False
    return True


def convert_column(text: Column | str, convert: Callable[[str], tuple]) -> Column:
    """STRUCT of output, error and stderr."""

    @F.pandas_udf(OUT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([convert(t) if isinstance(t, str) else (None, "no input", None) for t in texts], columns=["output", "error", "stderr"], dtype=object)

    return run(text)


def metric_column(pred: Column | str, target: Column | str, metric: Callable[[str, str], float] | None, name: str) -> Column:
    """STRUCT of score and error; without a metric, or where it raises, the score is null."""

    @F.pandas_udf("score double, error string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for p, t in zip(a, b, strict=True):
            try:
                rows.append((None, f"{name} is not available") if metric is None else (float(metric(p, t)), None))
            except Exception as why:  # a metric's failure is data
                rows.append((None, f"{type(why).__name__}: {why}"))
        return pd.DataFrame(rows, columns=["score", "error"]).astype({"score": "float64"})

    return run(pred, target)


def bounded_rate(edits: Column, fixes: Column, a: Column, b: Column) -> Column:
    """min(100, 100 (edits + fixes) / (a + b)): the semantic error rate over two sizes; both empty give 0."""
    return F.when(a + b == 0, 0.0).otherwise(F.least(F.lit(100.0), 100.0 * (edits + fixes) / (a + b)))


def predict(df: DataFrame, model: Callable[[pd.DataFrame], list[str]], key: str, columns: list[str]) -> DataFrame:
    """(key, prediction) by a batch model, made once for each task by the caller's closure."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "prediction": model(frame)})

    return df.select(key, *columns).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, prediction string")
