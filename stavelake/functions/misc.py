"""Token ids, Unicode, diffs, labels and counters."""

from __future__ import annotations

import difflib
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(texts: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([unicodedata.normalize("NFKC", t) if isinstance(t, str) else None for t in texts], dtype=object)

    return run(texts)


def pre_tokens(text: Column) -> Column:
    """Runs of white space and of anything else, in turn."""
    return F.regexp_extract_all(text, F.lit(r"[\t\n\r ]+|[^\t\n\r ]+"), F.lit(0))


def ids_to_text(ids: Column, vocabulary: dict[int, str], pad: int, end: int, begin: int, stop_at_end: bool = False) -> Column:
    """Text of token ids up to the padding; end marks are skipped, or end it too; begin marks are skipped."""
    words = F.create_map(*[x for k, v in vocabulary.items() for x in (F.lit(k), F.lit(v))])
    stops = [pad, end] if stop_at_end else [pad]
    first = F.array_min(F.transform(ids, lambda x, i: F.when(x.isin(stops), i)))
    kept = F.filter(F.slice(ids, F.lit(1), F.coalesce(first, F.size(ids))), lambda x: ~x.isin(end, begin))
    return F.array_join(F.transform(kept, lambda x: F.try_element_at(words, x)), "")


def line_diff(old: Column | str, new: Column | str) -> Column:
    @F.pandas_udf("added int, removed int, unified string")
    def run(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(old, new, strict=True):
            found = list(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), lineterm="", n=0))[2:]
            rows.append((sum(x[0] == "+" for x in found), sum(x[0] == "-" for x in found), "\n".join(found)))
        return pd.DataFrame(rows, columns=["added", "removed", "unified"]).astype({"added": "int32", "removed": "int32"})

    return run(old, new)


def side_by_side(old: Column | str, new: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        """An HTML table of both texts, changed rows marked."""

        def table(a: str, b: str) -> str:
            x, y = a.split("\n"), b.split("\n")
            out = []
            for tag, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                for n in range(max(j - i, m - k)):
                    left, right = x[i + n] if i + n < j else "", y[k + n] if k + n < m else ""
                    out.append(f'<tr class="{tag}"><td>{html.escape(left)}</td><td>{html.escape(right)}</td></tr>')
            return "<table>" + "".join(out) + "</table>"

        return pd.Series([table(a or "", b or "") for a, b in zip(old, new, strict=True)])

    return run(old, new)


def marker_group(name: Column, markers: list[tuple[str, str]], other: str = "unknown") -> Column:
    """The group of the first marker that the name contains, in the order given."""
    out = None
    for found, group in markers:
        test = F.lower(name).contains(found)
        out = F.when(test, group) if out is None else out.when(test, group)
    return F.lit(other) if out is None else out.otherwise(other)


def add_counters(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def milliseconds(seconds: Column) -> Column:
    """Rounded half to even, as a histogram's bucket."""
    return F.bround(seconds * 1000).cast("long")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def run_id(at: Column) -> Column:
    """Of a timestamp, in UTC sessions: 20240131T235959Z-123."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss"), F.lit("Z-"), F.date_format(at, "SSS"))


def iso_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
