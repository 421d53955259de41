"""Composition: plan samples from indexed sources, stitch their texts, cut prefixes, and finish broken sequences.

Planning is joins on (width, place): an entry's place among those of its width is an exact rank by hash, so a draw is an
equi-join and no index is gathered anywhere.  Draws come from SHA-256 of seed, sample and step.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.functions import kern as K
from stavelake.operators.corpus import exact_rank
from stavelake.operators.layout import spine_class
from stavelake.operators.rhythm import Checker, Spine, duration
from stavelake.operators.spines import SpineError, advance, is_merge, is_split, is_terminator, restore_width, significant

# Weights of segment counts and of the first segment's spine class, and the measures of a sample.
SEGMENTS = [(1, 0.62), (2, 0.28), (3, 0.10)]
ANCHORS = [("1", 0.30), ("2", 0.55), ("3_plus", 0.15)]
LEAST_MEASURES, MOST_MEASURES = 10, 32
DRAWS = 8


def uniform(*parts: Column) -> Column:
    """In [0, 1), from a hash of the parts."""
    h = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)


def weighted(roll: Column, weights: list[tuple]) -> Column:
    """The value in whose share of the total the roll falls."""
    total, upto, out = sum(w for _, w in weights), 0.0, None
    for value, w in weights[:-1]:
        upto += w / total
        out = F.when(roll <= upto, value) if out is None else out.when(roll <= upto, value)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])


def placed_entries(entries: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(entries with their place within their width, (width, size)): sizes are one row for each width."""
    hashed = entries.withColumn("h_", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("source_id")), 256))
    ranked = exact_rank(hashed, ["initial_spine_count", "h_", "source_id"]).drop("h_")
    sizes = ranked.groupBy(F.col("initial_spine_count").alias("width")).agg(F.count(F.lit(1)).alias("size"), F.min("rank").alias("first"))
    placed = ranked.join(F.broadcast(sizes), F.col("initial_spine_count") == F.col("width")).withColumn("place", F.col("rank") - F.col("first"))
    return placed.select("source_id", "width", "place", "measure_count", "non_empty_line_count", "restored_terminal_spine_count"), sizes.select("width", "size")


def plan_samples(entries: DataFrame, samples: int, seed: int = 0, excluded: DataFrame | None = None) -> DataFrame:
    """(sample, order, source_id, measure_count, ...): up to three sources a sample, each as wide at its start as the one
    before is at its end, and as near to the wanted measures as the best of ``DRAWS`` draws.

    ``entries`` is a source index with source_id; ``excluded`` (source_id) is quarantined or used up.
    """
    spark = entries.sparkSession
    if excluded is not None:
        entries = entries.join(excluded.select("source_id").distinct(), "source_id", "left_anti")
    placed, sizes = placed_entries(entries, seed)
    placed = placed.persist()
    wanted = (LEAST_MEASURES + F.floor(uniform(F.lit(seed), F.col("sample"), F.lit("measures")) * (MOST_MEASURES - LEAST_MEASURES + 1))).cast("long")
    rows = spark.range(samples).select(F.col("id").alias("sample"))
    rows = rows.select("sample", weighted(uniform(F.lit(seed), F.col("sample"), F.lit("segments")), SEGMENTS).alias("segments"), wanted.alias("wanted"), weighted(uniform(F.lit(seed), F.col("sample"), F.lit("class")), ANCHORS).alias("anchor"))
    # classes without entries give way to any width; widths are few rows
    widths = F.broadcast(sizes.withColumn("anchor", spine_class(F.col("width"))))
    some = F.broadcast(sizes.select(F.col("width").alias("any_width"), F.col("size").alias("any_size")))
    own = rows.join(widths, "anchor", "left").groupBy("sample", "segments", "wanted").agg(F.max_by(F.struct("width", "size"), F.col("size") * uniform(F.lit(seed), F.col("sample"), F.col("width"))).alias("w"))
    fallback = own.filter("w.width is null").join(some).groupBy("sample", "segments", "wanted").agg(F.max_by(F.struct(F.col("any_width").alias("width"), F.col("any_size").alias("size")), F.col("any_size")).alias("w"))
    state = own.filter("w.width is not null").unionByName(fallback).select("sample", "segments", "wanted", "w.width", F.lit(0).cast("long").alias("total"))
    state = state.withColumn("used", F.array().cast("array<string>"))
    out = None
    for order in range(max(n for n, _ in SEGMENTS)):
        draws = state.filter(F.col("segments") > order).join(F.broadcast(sizes), "width")
        draws = draws.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
        draws = draws.withColumn("place", F.floor(uniform(F.lit(seed), F.col("sample"), F.lit(order), F.col("draw")) * F.col("size")).cast("long"))
        met = draws.join(placed.withColumnRenamed("restored_terminal_spine_count", "end_width"), ["width", "place"])
        met = met.filter(~F.array_contains("used", F.col("source_id")) & ((F.col("total") + F.col("measure_count") <= MOST_MEASURES) | (F.col("total") < F.col("wanted"))))
        score = F.abs(F.col("wanted") - F.col("total") - F.col("measure_count")) + uniform(F.lit(seed), F.col("sample"), F.lit(order), F.col("draw"), F.lit("jitter")) * 0.25
        best = met.groupBy("sample", "segments", "wanted").agg(F.min_by(F.struct("source_id", "measure_count", "non_empty_line_count", "width", "end_width", "total", "used"), F.struct(score, F.col("source_id"))).alias("b"))
        step = best.select("sample", F.lit(order).alias("order"), "b.source_id", "b.measure_count", "b.non_empty_line_count", F.col("b.width").alias("initial_spine_count"))
        out = step if out is None else out.unionByName(step)
        state = best.select("sample", "segments", "wanted", F.col("b.end_width").alias("width"), (F.col("b.total") + F.col("b.measure_count")).alias("total"), F.array_append("b.used", F.col("b.source_id")).alias("used"))
    return out


# --- stitching -------------------------------------------------------------------------------------------------

_TRACKED = [re.compile(p) for p in (r"\*clef", r"\*k\[", r"\*(?:M\d|met\()")]  # clef, key, meter
Boundary = list[list[str | None]]


def _body(text: str, first: bool, last: bool) -> tuple[list[str], list[str]]:
    """(header records, body records) without the terminator where another segment follows."""
    rows = text.replace("\r\n", "\n").split("\n")
    if not last:
        while rows and (not rows[-1].strip() or is_terminator(rows[-1])):
            gone = rows.pop()
            if gone.strip():
                break
    while rows and not rows[-1].strip():
        rows.pop()
    if first:
        return [], rows
    k = next((i for i, r in enumerate(rows) if r.strip() and r.strip()[0] not in "!*"), len(rows))
    return rows[:k], rows[k:]


def _scan(rows: list[str], state: Boundary | None) -> Boundary | None:
    for r in rows:
        if not r.strip() or r.strip().startswith("!"):
            continue
        found = r.split("\t")
        if state is None:
            state = [[None] * len(found) for _ in _TRACKED]
        if len(found) != len(state[0]):
            raise ValueError("the width changes without an operation")
        state = [[f if p.match(f) else old for f, old in zip(found, values, strict=True)] for p, values in zip(_TRACKED, state, strict=True)]
        if is_split(r) or is_merge(r):
            state = [advance(values, found, merge=lambda group: group[0] if len(set(group)) == 1 else None) for values in state]
    return state


def compose(texts: list[str]) -> str:
    """One document: later headers become the records that change clef, key or meter, inner terminators go, and the last
    barline gets the first width back."""
    if not texts:
        raise ValueError("no segments")
    state: Boundary | None = None
    out: list[str] = []
    for i, text in enumerate(texts):
        head, rows = _body(restore_width(text), i == 0, i == len(texts) - 1)
        if i:
            start = _scan([r for r in head if not r.startswith("**")], None)
            width = next((len(r.split("\t")) for r in head + rows if r.strip() and not r.startswith("!")), None)
            if width is None:
                continue
            start = start or [[None] * width for _ in _TRACKED]
            if width != len(state[0]):
                raise ValueError(f"a segment of {width} spines after one of {len(state[0])}")
            changes = [[new if new is not None and new != old else "*" for new, old in zip(a, b, strict=True)] for a, b in zip(start, state, strict=True)]
            rows = ["\t".join(c) for c in changes if set(c) != {"*"}] + rows
        state = _scan(rows, state)
        out += rows
    composed = "\n".join(out).strip("\n")
    if not composed:
        raise ValueError("nothing left of the segments")
    return restore_width(composed) + "\n"


def compose_udf(lists: Column | str) -> Column:
    @F.pandas_udf("text string, error string")
    def run(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for texts in lists:
            try:
                rows.append((compose(list(texts)), None))
            except (ValueError, SpineError) as why:
                rows.append((None, str(why)))
        return pd.DataFrame(rows, columns=["text", "error"], dtype=object)

    return run(lists)


def materialise(plan: DataFrame, texts: DataFrame) -> DataFrame:
    """(sample, source_ids, text, error): texts (source_id, text) are joined only to what the plan chose."""
    rows = plan.join(texts.select("source_id", "text"), "source_id")
    parts = rows.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("order", "source_id", "text"))).alias("p"))  # three at most
    return parts.select("sample", F.transform("p", lambda x: x["source_id"]).alias("source_ids"), compose_udf(F.transform("p", lambda x: x["text"])).alias("c")).select("sample", "source_ids", "c.*")


# --- prefixes --------------------------------------------------------------------------------------------------


def prefix_candidates(text: Column) -> Column:
    """Array of (chunks, ratio, text): every proper prefix of chunks without trailing split or merge records; of equal
    ones that with the most chunks.  Null where chunks are uneven."""

    def prefixes(cs: Column) -> Column:
        n = F.size(cs)
        moves = r"(?:(?:^|\n)(?=[^\n]*\*[v^])(?:\*\^?(?:\t\*\^?)*|\*v?(?:\t\*v?)*))+\z"
        cut = lambda k: F.regexp_replace(F.array_join(F.slice(cs, F.lit(1), k), "\n"), moves, "")
        made = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(k.alias("chunks"), (k / n).alias("ratio"), cut(k).alias("text")))
        return F.when(n > 1, made)

    def longest(ps: Column) -> Column:
        later = lambda p: F.exists(ps, lambda q: (q["text"] == p["text"]) & (q["chunks"] > p["chunks"]))
        return F.filter(ps, lambda p: ~later(p) & (F.trim(p["text"]) != ""))

    return K.let(K.let(K.chunks(text), prefixes), longest)


def search_prefix(n: int, accepts: Callable[[int], bool], most_probes: int, radius: int = 2) -> tuple[int | None, list[int], bool]:
    """(best index, probed indexes, out of probes): binary search for the longest accepted of ``n`` prefixes, then its
    neighbours, for acceptance need not be monotone."""
    if most_probes < 1:
        raise ValueError(f"most_probes must be >= 1, got {most_probes}")
    seen: dict[int, bool] = {}
    out = False

    def probe(i: int) -> bool | None:
        nonlocal out
        if i not in seen:
            if len(seen) >= most_probes:
                out = True
                return None
            seen[i] = accepts(i)
        return seen[i]

    low, high, best, rejected = 0, n - 1, None, None
    while low <= high:
        mid = (low + high) // 2
        ok = probe(mid)
        if ok is None:
            break
        if ok:
            best, low = mid, mid + 1
        else:
            rejected = mid if rejected is None else rejected
            high = mid - 1
    center = best if best is not None else rejected
    around = list(range(max(0, center - radius), min(n - 1, center + radius) + 1)) if center is not None else []
    if rejected:
        around.append(rejected - 1)
    for i in around:
        if probe(i) is None:
            break
    return max((i for i, ok in seen.items() if ok), default=None), list(seen), out


def terminal_state_error(text: str) -> str | None:
    """Why a prefix cannot end where it does, or None."""
    bad = "invalid_terminal_spine_state"
    rows = [r for _, r in significant(text)]
    while rows and is_terminator(rows[-1]):
        rows.pop()
    state = [0] * len(rows[0].split("\t")) if rows else []
    for r in rows:
        if len(r.split("\t")) != len(state):
            return bad
        try:
            state = advance(state, r.split("\t"))
        except SpineError:
            return bad
    last = text.rstrip("\n").split("\n")[-1]
    if not state or is_split(last) or is_merge(last) or is_terminator(last) and len(last.split("\t")) != len(state):
        return bad
    return None


# --- finishing sequences ---------------------------------------------------------------------------------------


class Rules:
    """Spine structure and rhythm of a growing sequence: may this record close, may the sequence end.

    A record may not make a rhythm error, nor follow a measure that only the end could excuse.  Within a measure a spine
    sounds on until its note is over: a duration starts where the spine is free, and ``.`` stands where it is not.
    """

    def __init__(self) -> None:
        self.state: list[Fraction] | None = None  # where each spine is free again, from the last barline
        self.kern: list[bool] = []
        self.rhythm = Checker()
        self.line = 0
        self.ended = False

    def _sounding(self, fields: list[str]) -> list[Fraction] | None:
        """``state`` after a data record, or None where it is out of step."""
        now = min((s for s, k in zip(self.state, self.kern, strict=True) if k), default=Fraction(0))
        out, timed = list(self.state), False
        kinds = [f.split(" ")[0] for f in fields]
        lengths = [None if t == "." or "q" in t.lower() else duration(t) for t in kinds]
        timed = any(x is not None and k for x, k in zip(lengths, self.kern, strict=True))
        for i, (t, x) in enumerate(zip(kinds, lengths, strict=True)):
            if not self.kern[i] or not timed:
                continue
            if t == "." and out[i] <= now or x is not None and out[i] != now:
                return None
            if x is not None:
                out[i] = now + x
        return out

    def _next(self, record: str) -> tuple[list[Fraction], list[bool], Checker] | None:
        fields = record.split("\t")
        if self.ended or "" in fields or self.state is not None and len(fields) != len(self.state):
            return None
        if self.state is None:
            self.state, self.kern = [Fraction(0)] * len(fields), [f == "**kern" or not f.startswith("**") for f in fields]
        rhythm = self.rhythm.trial()
        if not rhythm.spines and not record.startswith("**"):
            rhythm.spines = [Spine(True) for _ in fields]
        bar, data = all(f[:1] == "=" for f in fields), record[:1] not in ("*", "=", "!")
        if rhythm.held and not bar and not is_terminator(record):
            return None
        state = self._sounding(fields) if data else [Fraction(0)] * len(fields) if bar else self.state
        if state is None:
            return None
        try:
            state = advance(state, fields, merge=max)
            kern = advance(self.kern, fields, merge=any)
        except SpineError:
            return None
        rhythm.accept(self.line + 1, record)
        return (state, kern, rhythm) if (state or is_terminator(record)) and not rhythm.errors else None

    def accepts(self, record: str) -> bool:
        return self._next(record) is not None

    def apply(self, record: str) -> None:
        if not self.take(record):
            raise ValueError(f"record {self.line + 1} cannot follow: {record!r}")

    def take(self, record: str) -> bool:
        """Applies the record if it is accepted."""
        found = self._next(record)
        if found is None:
            return False
        self.state, self.kern, self.rhythm = found
        self.line += 1
        self.ended = is_terminator(record)
        return True

    def terminator(self) -> str | None:
        return "\t".join(["*-"] * len(self.state)) if self.state and not self.ended else None


def finalize(text: str, saw_end: bool, hit_max: bool) -> dict:
    """Replays records, cuts at the first that cannot be, and ends what is left with a terminator."""
    cut_off = hit_max and not saw_end
    flags = {"trimmed_incomplete_tail": False, "appended_terminator": False, "hit_max_length": hit_max, "saw_eos": saw_end, "truncated": cut_off}
    if not text:
        return {"text": text, **flags}
    rules, kept, rows = Rules(), [], text.split("\n")
    tail = rows.pop()
    for r in rows:
        if not rules.take(r):
            flags["trimmed_incomplete_tail"] = True
            break
        kept.append(r)
    else:
        if tail and (is_terminator(tail) or not saw_end) and rules.take(tail):
            kept.append(tail)
        elif tail:
            flags["trimmed_incomplete_tail"] = True
    body = "\n".join(kept)
    end = rules.terminator()
    if kept and end:
        body, flags["appended_terminator"] = f"{body}\n{end}", True
    elif kept and not tail and not flags["trimmed_incomplete_tail"]:
        body += "\n"
    flags["truncated"] = flags["trimmed_incomplete_tail"] or cut_off
    return {"text": body, **flags}


FINALIZED = "text string, trimmed_incomplete_tail boolean, appended_terminator boolean, hit_max_length boolean, saw_eos boolean, truncated boolean"
FINALIZED_NAMES = [c.split(" ")[0] for c in FINALIZED.split(", ")]


def _finalized(text: str, saw_end: bool, hit_max: bool) -> tuple:
    found = finalize(text, saw_end, hit_max)
    return tuple(found[n] for n in FINALIZED_NAMES)


@lru_cache(4096)
def _short_finalized(text: str, saw_end: bool, hit_max: bool) -> tuple:
    return _finalized(text, saw_end, hit_max)


def finalize_column(text: Column | str, saw_end: Column, hit_max: Column) -> Column:
    """``finalize`` of each row; equal rows of a batch are worked out once, and short ones are remembered by the worker."""

    @F.pandas_udf(FINALIZED)
    def run(texts: pd.Series, ends: pd.Series, hits: pd.Series) -> pd.DataFrame:
        rows = [(t if isinstance(t, str) else "", bool(e), bool(h)) for t, e, h in zip(texts, ends, hits, strict=True)]
        done = {r: (_short_finalized if len(r[0]) <= 1024 else _finalized)(*r) for r in set(rows)}
        return pd.DataFrame([done[r] for r in rows], columns=FINALIZED_NAMES)

    return run(text, saw_end, hit_max)
