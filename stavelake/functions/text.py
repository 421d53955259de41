"""Document measures, error rates and percentiles as Column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavelake.functions.kern import all_fields, fields, is_bar_record, let, records

#: Symbols that fit into one block of code points; pairs with more go to Python.
MOST_SYMBOLS = 20_000
FIRST_SYMBOL = 0x4E00


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def nonblank(text: Column | str) -> Column:
    return F.filter(records(text), lambda r: r != "")


def line_count(text: Column | str) -> Column:
    return F.size(F.filter(records(text), lambda r: F.trim(r) != ""))


def measure_count(text: Column | str, loose: bool = False) -> Column:
    """Barlines: every field starts with ``=``, or loosely the record does."""
    return F.size(F.filter(records(text), (lambda r: r.startswith("=")) if loose else is_bar_record))


def max_spines(text: Column | str) -> Column:
    return F.array_max(F.transform(nonblank(text), lambda r: F.size(fields(r))))


def control_rate(text: Column | str) -> Column:
    rs = nonblank(text)
    return F.size(F.filter(rs, lambda r: r.rlike("^[*!=]"))) / F.nullif(F.size(rs), F.lit(0))


def repeat_deficit(text: Column | str) -> Column:
    """1 - distinct / total of the non-blank lines; 0 for none."""
    return let(nonblank(text), lambda rs: F.when(F.size(rs) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(rs)) / F.size(rs)))


def longest_run(items: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(x), s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(items, start, step, lambda s: s["best"])


def ngrams(items: Column, n: int) -> Column:
    places = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(items, i, F.lit(n)), "\x1f"))


def most_occurrences(items: Column, n: int) -> Column:
    """How often the most frequent n-gram occurs."""
    return let(items, lambda xs: longest_run(F.array_sort(ngrams(xs, n))))


def repeated_ngrams(items: Column, n: int) -> Column:
    """Distinct n-grams that occur more than once."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("found"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(x), s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), (s["found"] + F.when(run == 2, 1).otherwise(0)).alias("found"))

    return F.aggregate(let(items, lambda xs: F.array_sort(ngrams(xs, n))), start, step, lambda s: s["found"])


# Most n-gram occurrences, longest run of lines, length ratio, by strictness; n-grams of four lines.
STRICTNESS = {"lenient": (8, 10, 2.5), "moderate": (5, 6, 1.8), "strict": (3, 4, 1.4)}
RUNAWAY_N = 4


def runaway(text: Column | str, strictness: str = "moderate") -> Column:
    """Struct of the longest run, the most n-gram occurrences, their share of lines, the verdict and its reason."""
    if strictness not in STRICTNESS:
        raise ValueError(f"Unsupported strictness {strictness!r}. Expected one of {sorted(STRICTNESS)}")
    most, run_limit, _ = STRICTNESS[strictness]

    def judge(s: Column) -> Column:
        reason = F.when(s["run"] >= run_limit, "identical_line_run").when(s["most"] >= most, "repeated_ngram")
        return F.struct(
            s["run"].alias("max_run"), s["most"].alias("max_occurrences"), (s["most"] / F.greatest(s["n"], F.lit(1))).alias("coverage"), reason.isNotNull().alias("repeat_loop"), reason.alias("reason")
        )

    measured = lambda rs: F.struct(longest_run(rs).alias("run"), most_occurrences(rs, RUNAWAY_N).alias("most"), F.size(rs).alias("n"))
    return let(let(nonblank(text), measured), judge)


def catastrophic_loop(text: Column | str) -> Column:
    """A run of 8 lines, or 12 occurrences of four lines that make a third of the text."""
    return let(runaway(text), lambda r: (r["max_run"] >= 8) | ((r["max_occurrences"] >= 12) & (r["coverage"] >= 0.33)))


def length_blowup(pred_tokens: Column, target_tokens: Column, strictness: str = "moderate") -> Column:
    return pred_tokens / F.greatest(target_tokens, F.lit(1)) > STRICTNESS[strictness][2]


def _symbols(own: Column, alphabet: Column) -> Column:
    """A string with one code point for each item."""
    point = lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position(alphabet, x) + (FIRST_SYMBOL - 1)), 4, "0")), "UTF-16BE")
    return F.array_join(F.transform(own, point), "")


def _slow_distance(a: Column | str, b: Column | str) -> Column:
    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def distance(x: list, y: list) -> int:
            """Bit-parallel (Myers, Hyyrö): a column of differences is two numbers."""
            if not x:
                return len(y)
            places: dict[str, list[int]] = {}
            for i, p in enumerate(x):
                places.setdefault(p, []).append(i)
            full, top, score = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x)
            up, down = full, 0
            for q in y:
                same = 0
                for i in places.get(q, ()):
                    same |= 1 << i
                level = (((same & up) + up) ^ up) | same | down
                right, left = (down | ~(level | up)) & full, level & up
                score += bool(right & top) - bool(left & top)
                right = right << 1 | 1
                up, down = (left << 1 | ~(level | right)) & full, right & level & full
            return score

        return pd.Series([None if x is None or y is None else distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run(a, b)


def sequence_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of strings; JVM-side unless a pair has over ``MOST_SYMBOLS`` distinct ones."""

    def by_symbol(s: Column) -> Column:
        alphabet = F.array_distinct(F.concat(s["a"], s["b"]))
        return let(alphabet, lambda z: F.levenshtein(_symbols(s["a"], z), _symbols(s["b"], z)))

    many = F.size(F.array_distinct(F.concat(a, b))) > MOST_SYMBOLS
    few = let(F.struct(F.when(~many, a).alias("a"), F.when(~many, b).alias("b")), by_symbol)
    return F.coalesce(few, exact_sequence_distance(F.when(many, a), F.when(many, b)))


def exact_sequence_distance(a: Column, b: Column) -> Column:
    """``sequence_distance`` without its limit, in Python."""
    return _slow_distance(a, b)


def cer(pred: Column | str, target: Column | str) -> Column:
    p, t = _c(pred), _c(target)
    return F.when(F.length(t) == 0, 0.0).otherwise(100.0 * F.levenshtein(p, t) / F.length(t))


def ser(pred: Column | str, target: Column | str) -> Column:
    p, t = words(pred), words(target)
    return F.when(F.size(t) == 0, 0.0).otherwise(100.0 * sequence_distance(p, t) / F.size(t))


def stripped_lines(text: Column | str) -> Column:
    return F.split(F.regexp_replace(_c(text), r"^\s+|\s+\z", ""), "\n", -1)


def ler(pred: Column | str, target: Column | str) -> Column:
    """An empty target is one empty line, so its rate is not 0."""
    p, t = stripped_lines(pred), stripped_lines(target)
    return 100.0 * sequence_distance(p, t) / F.size(t)


def percentiles(df: DataFrame, value: str, p: float = 0.95) -> DataFrame:
    """One row with the five definitions: linear, nearest rank, rounded index (half to even), weighted rank over the
    histogram, truncated index.  All are order statistics of one histogram with running counts; nulls do not count."""
    from stavelake.operators.corpus import running_counts

    histogram = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    counted = running_counts(histogram, value, "n").join(F.broadcast(histogram.agg(F.sum("n").alias("total_"))))
    n, v = F.col("total_"), F.col(value)
    at = lambda k: F.min(F.when(F.col("upto") > F.greatest(F.lit(0), F.least(k, n - 1)), v))
    place = (n - 1) * p
    found = counted.agg(
        at(F.floor(place)).alias("low_"),
        at(F.ceil(place)).alias("high_"),
        F.max(place - F.floor(place)).alias("part_"),
        at(F.ceil(n * p) - 1).alias("nearest_rank"),
        at(F.bround(place)).alias("rounded_index"),
        at(F.floor(n * int(p * 100) / 100)).alias("truncated_index"),
        F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.bround(n * p)), v)).alias("weighted_rank"),
    )
    linear = F.col("low_") + (F.col("high_") - F.col("low_")) * F.col("part_")
    return found.select(linear.alias("linear"), "nearest_rank", "rounded_index", "truncated_index", "weighted_rank")


def spine_operations(text: Column | str) -> Column:
    """Occurrences of each spine operation's mark."""
    marks = {"splits": r"\*\^", "merges": r"\*v", "exchanges": r"\*x", "adds": r"\*\+", "ends": r"\*-"}
    return F.struct(*(F.regexp_count(_c(text), F.lit(m)).alias(k) for k, m in marks.items()))


def contains_music(text: Column | str) -> Column:
    return F.exists(records(text), lambda r: ~r.rlike("^[*!=]") & r.rlike("[a-gA-Gr]"))


def only_null_fields(record: Column) -> Column:
    return all_fields(record, lambda f: f == ".")
