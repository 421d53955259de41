"""Reports: rates, counters, shares, calibration and run summaries as single aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold_rates(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, rate) of values at or above each; one pass."""
    x = F.col(value)
    counts = df.agg(F.count(value).alias("total"), *(F.count_if(x >= t).alias(f"c{i}") for i, t in enumerate(thresholds)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("n")) for i, t in enumerate(thresholds))))
    return counts.select(rows.alias("r"), "total").select("r.threshold", "r.n", (F.col("r.n") / F.nullif("total", F.lit(0))).alias("rate"))


def flag_counts(df: DataFrame, flags: dict[str, Column], by: str | None = None) -> DataFrame:
    """Rows and counts of each flag, in all or by group."""
    aggs = [F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in flags.items())]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def sample_summary(df: DataFrame, group: str, scores: list[str], failed: str) -> DataFrame:
    """Means over what is there, and the share of rows that did not fail."""
    ok = 100.0 * F.count_if(~F.col(failed)) / F.count(F.lit(1))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("num_samples"), ok.alias("success_rate"), *(F.avg(s).alias(s) for s in scores))


def micro_rate(df: DataFrame, edits: str, length: str, leave_out: Column) -> DataFrame:
    """Rate of sums over rows not left out, with both counts; empty targets do not count."""
    use = ~F.coalesce(leave_out, F.lit(False)) & (F.col(length) > 0)
    rate = 100.0 * F.sum(F.when(use, F.col(edits))) / F.sum(F.when(use, F.col(length)))
    return df.agg(rate.alias("rate"), F.count_if(use).alias("included"), F.count_if(~use).alias("excluded"))


def loop_recovery(df: DataFrame, detail: str) -> DataFrame:
    """Counts of the steps of loop recovery out of a nested JSON text."""
    d = F.from_json(detail, "primary_detected boolean, rerun_attempted boolean, replaced_prediction boolean")
    return df.select(d.alias("d")).agg(
        F.count_if("d.primary_detected").alias("detected"), F.count_if("d.rerun_attempted").alias("rerun"), F.count_if("d.replaced_prediction").alias("replaced")
    )


def time_shares(df: DataFrame, parts: list[str], total: str, items: str) -> DataFrame:
    """Share of each part in the total time, and items a second; 0 where there was no time."""
    share = lambda c: F.when(F.sum(total) > 0, 100.0 * F.sum(c) / F.sum(total)).otherwise(0.0)
    rate = F.when(F.sum(total) > 0, F.sum(items) / F.sum(total)).otherwise(0.0)
    return df.agg(*(share(c).alias(f"{c}_share") for c in parts), rate.alias("per_second"))


def dominant(shares: dict[str, Column]) -> Column:
    """Name of the largest; of equal ones the first."""
    best = F.greatest(*shares.values())
    out = None
    for name, c in shares.items():
        out = F.when(c == best, name) if out is None else out.when(c == best, name)
    return out


def rejection_rates(df: DataFrame, reason: str, attempted: Column, finished: Column) -> DataFrame:
    """(reason, n, and its share of all rows, of attempted ones and of finished ones; null for none)."""
    totals = df.agg(F.count(F.lit(1)).alias("all_"), F.count_if(attempted).alias("tried_"), F.count_if(finished).alias("done_"))
    counts = df.filter(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    rate = lambda c: F.col("n") / F.nullif(F.col(c), F.lit(0))
    return counts.join(F.broadcast(totals)).select("reason", "n", rate("all_").alias("of_all"), rate("tried_").alias("of_attempted"), rate("done_").alias("of_finished"))


def ambiguous_summary(df: DataFrame, value: str, ambiguous: str) -> DataFrame:
    """Least, median (whole) and largest value, and the share of ambiguous rows."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), (100.0 * F.count_if(F.col(ambiguous)) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("ambiguous_rate"), F.min(value).alias("low"), F.median(value).cast("long").alias("median"), F.max(value).alias("high")
    )


def least_confident(df: DataFrame, ambiguous: str, confidence: str, name: str, k: int = 10) -> DataFrame:
    return df.filter(F.col(ambiguous)).orderBy(confidence, name).limit(k)


def unpivoted_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) for several categorical columns at once, nulls left out."""
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    return df.select(rows.alias("r")).select("r.*").filter("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def series_on_axis(frames: dict[str, DataFrame], axis: list[int], key: str, n: str) -> DataFrame:
    """Counts of several frames on one fixed axis, 0 where there are none."""
    spark = next(iter(frames.values())).sparkSession
    out = spark.createDataFrame([(a,) for a in axis], "axis long")
    for name, f in frames.items():
        counts = f.groupBy(F.col(key).cast("long").alias("axis")).agg(F.sum(n).alias(name))
        out = out.join(F.broadcast(counts.filter(F.col("axis").isin(axis))), "axis", "left")
    return out.fillna(0, list(frames))


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the pace so far; null before the first."""
    return F.when(done > 0, elapsed / done * (total - done))


def constrained_deltas(pairs: DataFrame, with_: str, without: str) -> DataFrame:
    """Of pairs of runs (two structs of batch_ms, generate_ms, samples_per_second, tokens_per_second): the run with constraints
    less the one without, and how many times as long its batches take (0 where the other took no time)."""
    a, b = F.col(with_), F.col(without)
    rest = [c for c in pairs.columns if c not in (with_, without)]
    fields = {"batch_ms": "batch_ms_delta", "generate_ms": "generate_ms_delta", "samples_per_second": "samples_per_second_delta", "tokens_per_second": "tokens_per_second_delta"}
    slowdown = F.when(b["batch_ms"] > 0, a["batch_ms"] / b["batch_ms"]).otherwise(0.0)
    return pairs.select(*rest, slowdown.alias("slowdown"), *((a[f] - b[f]).alias(name) for f, name in fields.items()))


def cost_verdict(grammar: Column, semantic: Column, generate: Column, delta: Column) -> Column:
    """What makes decoding slow: with a counterpart (``delta``, in ms) half of the difference decides, else the larger."""
    bound = F.greatest(F.lit(1.0), delta * 0.5)
    compared = F.when((semantic >= grammar) & (semantic >= bound), "semantic").when((grammar > semantic) & (grammar >= bound), "grammar").when(delta > 0, "model")
    alone = F.when((semantic > grammar) & (semantic > 0), "semantic").when((grammar >= semantic) & (grammar > 0), "grammar").when(generate > 0, "model")
    return F.coalesce(F.when(delta.isNotNull(), compared), alone, F.lit("inconclusive"))
