"""Filter cascade: ordered checks, the first that does not pass names the rejecting filter."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.functions import kern as K

#: A check gives the reason for which a text fails, or null.
Check = Callable[[Column], Column]


def utf8(content: Column) -> Column:
    """Of binary content, or of a text whose bytes were taken as they are."""
    return F.when(~F.is_valid_utf8(content), "Invalid UTF-8 encoding")


def termination() -> Check:
    def check(text: Column) -> Column:
        body = F.regexp_replace(text, r"\n+$", "")
        rows = K.records(body)
        last = F.element_at(F.filter(rows, lambda r: F.lit(True)), -1)
        kept = F.aggregate(F.reverse(rows), F.lit(None).cast("string"), lambda found, r: F.when(found.isNotNull(), found).when(~r.startswith("!!!"), r))
        return F.when(body == "", "Empty file").when(kept.isNull() & last.isNotNull(), "File contains only comments").when(~K.is_terminator_record(kept), "Missing spine terminators")

    return check


def header_clef() -> Check:
    """Each kern column of the first exclusive record needs a clef before its first data; columns do not follow splits."""

    def check(text: Column) -> Column:
        body = F.regexp_replace(text, r"\n+$", "")
        rows = K.records(body)
        is_kern = lambda f: f.startswith("**kern") | f.startswith("**ekern")
        head = F.array_min(F.transform(rows, lambda r, i: F.when(r.rlike(r"^\*\*[^\t]*(\t\*\*[^\t]*)*$") & F.exists(K.fields(r), is_kern), i)))
        columns = F.filter(F.transform(K.fields(rows[head]), lambda f, j: F.when(is_kern(f), j)), lambda j: j.isNotNull())
        after = F.filter(F.slice(rows, head + 2, F.size(rows)), lambda r: ~r.startswith("!"))
        at = lambda test: lambda j: F.array_min(F.transform(after, lambda r, i: F.when(test(F.get(K.fields(r), j)), i)))
        clefs = F.transform(columns, at(lambda f: f.startswith("*clef")))
        data = F.array_min(F.transform(columns, at(lambda f: ~f.startswith("*") & ~f.startswith("!"))))
        ready = F.when(F.forall(clefs, lambda k: k.isNotNull()), F.array_max(clefs))
        return F.when(body == "", "Empty file").when(head.isNull(), "No spine declaration found").when(ready.isNull() | (data < ready), "Missing header clef declaration")

    return check


def rational_duration() -> Check:
    return lambda text: F.when(text.rlike(r"\d+%\d+"), F.concat(F.lit("Rational duration found: "), F.regexp_extract(text, r"\d+%\d+", 0)))


def accidentals(max_accidentals: int = 2) -> Check:
    found = rf"[a-gA-G](#{{{max_accidentals + 1},}}|-{{{max_accidentals + 1},}})"
    return lambda text: F.when(text.rlike(found), F.concat(F.lit("Too many accidentals: "), F.regexp_extract(text, found, 0)))


def excessive_octave(max_repetitions: int = 6) -> Check:
    found = rf"[a-gA-G]{{{max_repetitions + 1},}}"
    return lambda text: F.when(text.rlike(found), F.concat(F.lit("Excessive octave: "), F.regexp_extract(text, found, 0)))


def rhythm(**options: bool) -> Check:
    """The rhythm checker's first error.  Python; keep it last, after cheaper checks."""

    @F.pandas_udf("string")
    def check(texts: pd.Series) -> pd.Series:
        from stavelake.operators.rhythm import check_text

        return pd.Series([str(e[0]) if isinstance(t, str) and (e := check_text(t, **options)["errors"]) else None for t in texts], dtype=object)

    return check


REGISTRY: dict[str, Callable[..., Check]] = {"utf8": lambda: utf8} | {
    f.__name__: f for f in (termination, header_clef, rational_duration, accidentals, excessive_octave, rhythm)
}
DEFAULT = [{"name": n} for n in ("utf8", "termination", "header_clef", "rational_duration", "accidentals", "excessive_octave", "rhythm")]


class Cascade:
    """Checks in order, from a list of {"name", "params"} or pairs (name, check)."""

    def __init__(self, checks: list):
        self.checks: list[tuple[str, Check]] = []
        for c in checks:
            if isinstance(c, dict):
                if c["name"] not in REGISTRY:
                    raise ValueError(f"No filter is called {c['name']!r} (Available are {', '.join(sorted(REGISTRY))})")
                c = c["name"], REGISTRY[c["name"]](**c.get("params", {}))
            self.checks.append(c)

    @classmethod
    def from_config(cls, text: str) -> Cascade:
        return cls(json.loads(text)["filters"])

    def __call__(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``rejecting_filter`` and ``reason``, null where all checks pass.

        A check runs only where those before it passed, Python ones too: each is asked of a text that is null once an
        earlier one failed.
        """
        out = docs.withColumns({"rejecting_filter": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
        for name, check in self.checks:
            out = out.withColumn("found_", F.when(F.col("rejecting_filter").isNull(), check(F.when(F.col("rejecting_filter").isNull(), F.col(text)))))
            out = out.withColumns({"rejecting_filter": F.coalesce("rejecting_filter", F.when(F.col("found_").isNotNull(), name)), "reason": F.coalesce("reason", "found_")}).drop("found_")
        return out

    def stats(self, checked: DataFrame) -> DataFrame:
        """(filter, reached, passed, failed): a row counts only for the filters that it reached."""
        order = {name: i for i, (name, _) in enumerate(self.checks)}
        counts = checked.groupBy("rejecting_filter").agg(F.count(F.lit(1)).alias("n"))
        listed = checked.sparkSession.createDataFrame([(n, i) for n, i in order.items()], "filter string, place int")
        rejected = listed.join(counts.withColumnRenamed("rejecting_filter", "filter"), "filter", "left").select("filter", "place", F.coalesce("n", F.lit(0)).alias("failed"))
        rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        earlier = rejected.alias("a").join(rejected.alias("b"), F.col("b.place") < F.col("a.place"), "left").groupBy("a.filter", "a.place", "a.failed").agg(F.coalesce(F.sum("b.failed"), F.lit(0)).alias("gone"))
        reached = F.col("rows") - F.col("gone")
        return earlier.join(F.broadcast(rows)).select("filter", reached.alias("reached"), (reached - F.col("failed")).alias("passed"), "failed")


def reasons(checked: DataFrame) -> DataFrame:
    return checked.filter("rejecting_filter is not null").groupBy("rejecting_filter", "reason").agg(F.count(F.lit(1)).alias("n"))
