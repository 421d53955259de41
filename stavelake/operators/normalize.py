"""Normaliser: an ordered list of passes compiled to as few steps as possible.

Passes before the first state machine and after the last one are projections; from the first to the last all run in one
Arrow function, stateless ones among them in their text form.  A pass that raises rejects the document: its text becomes
null, and error_type and error say why.  Counts of dropped marks are a map column.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from stavelake.operators import passes as P
from stavelake.operators import passes_text as T


@dataclass(frozen=True)
class Pass:
    name: str
    column: Callable[[Column], Column] | None = None
    text: Callable[[str, Counter], str] | None = None
    check: Callable[[Column], Column] | None = None  # error message or null, after the pass


_COLUMNS = [P.cleanup_kern, P.strip_terminal_terminator, P.remove_grace_rests, P.remove_null_lines, P.canonicalize_barlines, P.cap_slurs, P.canonicalize_header_order, P.normalize_null_keysig]
_COLUMNS += [P.remove_contradictory_accidentals, P.remove_conflicting_bowings, P.remove_null_ties, P.normalize_final_barline]
_MACHINES = [P.remove_non_kern_spines, P.normalize_rscale, P.remove_redundant_stria, P.merge_split_normalizer, P.canonicalize_spine_splits, P.hoist_spine_splits_to_barline]
_MACHINES += [P.delay_spine_merges_to_barline, P.remove_redundant_time_signatures, P.merge_header_clef_lines, P.canonicalize_note_order, P.order_notes, P.symbols_before_split]
_MACHINES += [P.validate_spine_operations, P.repair_interpretation_spacing, P.fix_note_beams, P.fix_ties, P.fix_slurs]

REGISTRY: dict[str, Pass] = {f.__name__: Pass(f.__name__, f, getattr(T, f.__name__)) for f in _COLUMNS} | {f.__name__: Pass(f.__name__, text=f) for f in _MACHINES}
REGISTRY["remove_leading_barlines"] = Pass("remove_leading_barlines", P.remove_leading_barlines, T.remove_leading_barlines, P.leading_barlines_error)

#: The full pipeline, in order.
FULL = """
remove_non_kern_spines cleanup_kern strip_terminal_terminator normalize_rscale remove_grace_rests remove_redundant_stria
remove_leading_barlines remove_null_lines canonicalize_barlines merge_split_normalizer canonicalize_spine_splits
hoist_spine_splits_to_barline delay_spine_merges_to_barline cap_slurs remove_redundant_time_signatures
canonicalize_header_order merge_header_clef_lines normalize_null_keysig canonicalize_note_order order_notes
symbols_before_split remove_contradictory_accidentals remove_conflicting_bowings remove_null_ties
validate_spine_operations
""".split()


class Pipeline:
    """An editable list of passes."""

    def __init__(self, names: list[str] = FULL):
        for name in names:
            if name not in REGISTRY:
                raise ValueError(f"Unknown pass {name!r}. Available: {', '.join(sorted(REGISTRY))}")
        self.names = list(names)

    def add(self, name: str, at: int | None = None) -> Pipeline:
        names = list(self.names)
        names.insert(len(names) if at is None else at, name)
        return Pipeline(names)

    def remove(self, name: str) -> Pipeline:
        if name not in self.names:
            raise ValueError(f"No pass {name!r} in this pipeline")
        return Pipeline([n for n in self.names if n != name])

    def to_config(self) -> str:
        return json.dumps({"passes": [{"name": n} for n in self.names]})

    @classmethod
    def from_config(cls, text: str) -> Pipeline:
        return cls([p if isinstance(p, str) else p["name"] for p in json.loads(text)["passes"]])

    def steps(self) -> list[tuple[bool, list[Pass]]]:
        """(in Python, passes) of at most three steps."""
        found = [REGISTRY[n] for n in self.names]
        machines = [i for i, p in enumerate(found) if p.column is None]
        begin, end = (machines[0], machines[-1] + 1) if machines else (len(found), len(found))
        return [(python, part) for python, part in ((False, found[:begin]), (True, found[begin:end]), (False, found[end:])) if part]

    def __call__(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``text`` normalised, and columns error_type, error and drop_counts."""
        out = docs.withColumns({"error_type": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "drop_counts": F.create_map().cast("map<string,bigint>")})
        for python, step in self.steps():
            out = _machines(out, text, step) if python else _columns(out, text, step)
        return out


def _columns(df: DataFrame, text: str, step: list[Pass]) -> DataFrame:
    for p in step:
        df = df.withColumn(text, p.column(F.col(text)))
        if p.check:
            message = p.check(F.col(text))
            df = df.withColumn("error_", message)
            df = df.withColumns(
                {
                    "error_type": F.when(F.col("error_").isNotNull() & F.col("error").isNull(), "ValueError").otherwise(F.col("error_type")),
                    "error": F.coalesce("error", "error_"),
                    text: F.when(F.col("error_").isNull(), F.col(text)),
                }
            ).drop("error_")
    return df


def _machines(df: DataFrame, text: str, step: list[Pass]) -> DataFrame:
    """One Arrow hop for the whole step; all other columns pass through as they are."""
    machines = [p.text for p in step]
    names = df.columns
    at, kind, message, counts = (names.index(c) for c in (text, "error_type", "error", "drop_counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts, kinds, messages, drops = ([] for _ in range(4))
            for value, k, m, d in zip(*(columns[i].to_pylist() for i in (at, kind, message, counts)), strict=True):
                found = Counter(dict(d or []))
                if value is not None:
                    try:
                        for machine in machines:
                            value = machine(value, found)
                    except (ValueError, AssertionError) as why:
                        value, k, m = None, type(why).__name__, str(why)
                texts.append(value)
                kinds.append(k)
                messages.append(m)
                drops.append(list(found.items()))
            for i, new in ((at, texts), (kind, kinds), (message, messages), (counts, drops)):
                columns[i] = pa.array(new, columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T_.StructType([T_.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return df.mapInArrow(run, schema)


def rejection_counts(done: DataFrame) -> DataFrame:
    """(error_type, n) most frequent first, then by name."""
    return done.filter("error_type is not null").groupBy("error_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error_type")


def dropped_marks(done: DataFrame) -> DataFrame:
    """(mark, n) over all documents."""
    return done.select(F.explode("drop_counts").alias("mark", "n")).groupBy("mark").agg(F.sum("n").alias("n"))


def normalise(docs: DataFrame, text: str = "text") -> DataFrame:
    return Pipeline()(docs, text)


__all__ = ["FULL", "REGISTRY", "Pass", "Pipeline", "dropped_marks", "normalise", "rejection_counts"]
