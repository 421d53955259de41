"""Corpus assembly, comparison and reporting: joins, sets, top-k, samples, aggregates.

Everything is a declarative plan.  Frames are read by column, ties are ordered by a stated key, and random choice is by
hash, so that results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tokens = Callable[[Column], Column]


def token_length(text: Column) -> Column:
    """Default tokenizer: runs of white space and of other characters, and one end mark."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\t\n\r ]+|[^\t\n\r ]+"), F.lit(0))) + 1


def length_filter(df: DataFrame, text: str, most: int, length: Tokens = token_length) -> tuple[DataFrame, DataFrame]:
    """(rows of at most ``most`` tokens, a row of statistics before and after)."""
    measured = df.withColumn("token_length", length(F.col(text)))
    fits = F.col("token_length") <= most
    stats = measured.agg(
        F.count(F.lit(1)).alias("before"),
        F.count_if(fits).alias("after"),
        F.max("token_length").alias("longest"),
        F.percentile("token_length", 0.99).alias("p99"),
        F.percentile(F.when(fits, F.col("token_length")), 0.99).alias("p99_after"),
    )
    return measured.filter(fits), stats


def duplicates(df: DataFrame, text: str) -> DataFrame:
    """Distinct texts and rows beyond them, by digest: the count is of groups, no text is shuffled."""
    return df.groupBy(F.sha2(text, 256).alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("distinct_texts"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def split_leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count(F.lit(1)).alias("n")).filter(F.size("splits") > 1)


def hash_split(df: DataFrame, key: str, validation: float, salt: str = "split", seed: int = 0) -> DataFrame:
    """``df`` with ``digest`` and ``split``: the share of rows with the least SHA-256 of salt, seed and key validate."""
    digest = F.sha2(F.concat(F.lit(f"{salt}\x01{seed}\x01"), F.col(key).cast("string")), 256)
    bound = f"{int(validation * 0xFFFFFFFF):08x}"
    return df.withColumn("digest", digest).withColumn("split", F.when(F.substring("digest", 1, 8) < bound, "validation").otherwise("train"))


def union_aligned(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def oversample(df: DataFrame, key: str, target: int, rows: int) -> DataFrame:
    """``rows`` rows to ``target``: whole copies, and one more of those that come first by hash; ``copy`` numbers them."""
    whole, more = divmod(target, rows)
    h = F.sha2(F.col(key).cast("string"), 256)
    extra = df.orderBy(h, key).limit(more).select(F.col(key).alias("key_")) if more else None
    out = df.withColumn("copies_", F.lit(whole))
    if extra is not None:
        out = out.join(extra, F.col(key) == F.col("key_"), "left").withColumn("copies_", F.lit(whole) + F.when(F.col("key_").isNotNull(), 1).otherwise(0)).drop("key_")
    return out.filter("copies_ > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies_"))).drop("copies_")


def top_rows(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def best_and_worst(df: DataFrame, group: str, score: str, key: str, best: int = 5, worst: int = 20) -> DataFrame:
    """Per group the lowest and the highest scores; of equal ones the higher key comes first.  ``kind`` tells which."""
    low = Window.partitionBy(group).orderBy(F.asc(score), F.desc(key))
    high = Window.partitionBy(group).orderBy(F.desc(score), F.desc(key))
    ranked = lambda kind, w, k: df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).withColumn("kind", F.lit(kind))
    return ranked("best", low, best).unionByName(ranked("worst", high, worst))


def select_fill(candidates: DataFrame, base: DataFrame, key: str, text: str, length: Column, most: int, layout: Column, order: list[Column], k: int) -> tuple[DataFrame, DataFrame]:
    """(the first k candidates, counts by outcome): too long, a text of the base, a text seen before, without layout."""
    h = F.sha2(text, 256)
    known = base.select(h.alias("h_")).distinct().withColumn("known_", F.lit(True))
    rows = candidates.withColumn("h_", h).join(known, "h_", "left")
    # of rows that are short and new, the first by key counts
    eligible = (length <= most) & F.col("known_").isNull()
    first = rows.filter(eligible).groupBy("h_").agg(F.min(key).alias("first_"))
    rows = rows.join(first, "h_", "left")
    outcome = (
        F.when(length > most, "too_long").when(F.col("known_"), "duplicate_of_base").when(F.col(key) != F.col("first_"), "duplicate_candidate").when(layout.isNull(), "no_layout").otherwise("eligible")
    )
    rows = rows.withColumn("outcome", outcome).drop("h_", "known_", "first_")
    return rows.filter("outcome = 'eligible'").drop("outcome").orderBy(*order).limit(k), rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def resolve(rows: DataFrame, direct: DataFrame, by_text: DataFrame, key: str, text: str, seed: int = 0) -> DataFrame:
    """Rows with ``resolved`` and ``status``: by key first, then by text; of several candidates one by hash.

    ``direct`` is (key, value), ``by_text`` (text, value).
    """
    d = direct.select(F.col(key).alias("k_"), F.col("value").alias("direct_"))
    roll = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(text)), 256), 1, 8), 16, 10).cast("long")
    # one row for each text: how many candidates it has, and the one that is picked
    found = by_text.select(F.sha2(text, 256).alias("t_"), "value", roll.alias("roll_")).distinct()
    sizes = found.groupBy("t_").agg(F.count(F.lit(1)).alias("n_"))
    placed = found.join(sizes, "t_").withColumn("place_", F.row_number().over(Window.partitionBy("t_").orderBy("value")) - 1)
    picked = placed.filter(F.col("place_") == F.pmod("roll_", "n_")).select("t_", "n_", F.col("value").alias("picked_"))
    out = rows.join(d, F.col(key) == F.col("k_"), "left").withColumn("h_", F.sha2(text, 256)).join(picked, F.col("h_") == F.col("t_"), "left")
    status = F.when(F.col("direct_").isNotNull(), "direct").when(F.col("n_") == 1, "unique").when(F.col("n_") > 1, "ambiguous").otherwise("missing")
    return out.withColumns({"status": status, "resolved": F.coalesce("direct_", "picked_")}).drop("k_", "direct_", "t_", "h_", "n_", "picked_")


def stage_drops(spark, stages: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(place, stage, next_stage, before, after, dropped, rate) along a chain of stages, by anti joins."""
    out = None
    for i, ((a, x), (b, y)) in enumerate(zip(stages, stages[1:], strict=False)):
        xs, ys = x.select(key).distinct(), y.select(key).distinct()
        row = xs.join(ys.withColumn("kept_", F.lit(1)), key, "left").agg(F.count(F.lit(1)).alias("before"), F.count("kept_").alias("after"))
        dropped = F.col("before") - F.col("after")
        row = row.select(F.lit(i).alias("place"), F.lit(a).alias("stage"), F.lit(b).alias("next_stage"), "before", "after", dropped.alias("dropped"), (dropped / F.nullif("before", F.lit(0))).alias("rate"))
        out = row if out is None else out.unionByName(row)
    return out


def worst_drop(report: DataFrame) -> DataFrame:
    """The stage that drops most; of equal ones the first."""
    return report.orderBy(F.desc("dropped"), "place").limit(1)


def interval_overlaps(ranges: DataFrame, name: str, low: str, high: str) -> DataFrame:
    """Pairs a < b of ranges that overlap, with the overlap.  Ranges are groups: a few rows, joined by comparison."""
    a, b = ranges.alias("a"), ranges.alias("b")
    meet = (F.col(f"a.{name}") < F.col(f"b.{name}")) & (F.greatest(f"a.{low}", f"b.{low}") <= F.least(f"a.{high}", f"b.{high}"))
    return a.join(b, meet).select(
        F.col(f"a.{name}").alias("left_name"), F.col(f"b.{name}").alias("right_name"), F.greatest(f"a.{low}", f"b.{low}").alias("overlap_low"), F.least(f"a.{high}", f"b.{high}").alias("overlap_high")
    )


def macro_micro(df: DataFrame, group: str, edits: Column, length: Column) -> DataFrame:
    """(group, n, macro, micro) with the total as a null group: mean of rates, and rate of sums; empty targets do not
    count."""
    rows = df.select(F.col(group).alias("grp"), edits.alias("e"), length.alias("l")).filter("l > 0")
    return rows.rollup("grp").agg(F.count(F.lit(1)).alias("n"), F.avg(100.0 * F.col("e") / F.col("l")).alias("macro"), (100.0 * F.sum("e") / F.sum("l")).alias("micro"))


def worst_score_mean(df: DataFrame, group: str, score: str, worst: float = 100.0) -> DataFrame:
    """A missing score counts as the worst."""
    return df.rollup(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col(score).isNull()).alias("failures"), F.avg(F.coalesce(score, F.lit(worst))).alias("score"))


def weighted_overall(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    has = F.col(value).isNotNull()
    return df.groupBy(F.col(group).alias("grp")).agg((F.sum(F.when(has, F.col(value) * F.col(weight))) / F.sum(F.when(has, F.col(weight)))).alias("overall"), F.sum(weight).alias("weight"))


def calibration(df: DataFrame, spine_class: str, bucket: str, value: str) -> DataFrame:
    """q20, q80 and median by (class, bucket), and by bucket for class ``all``."""
    both = df.select(F.explode(F.array(F.col(spine_class), F.lit("all"))).alias("spine_class"), F.col(bucket).alias("bucket"), F.col(value).alias("v"))
    return both.groupBy("spine_class", "bucket").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.2).alias("q20"), F.percentile("v", 0.8).alias("q80"), F.percentile("v", 0.5).alias("median"))


def profile(df: DataFrame, top: int = 5) -> DataFrame:
    """(column_name, kind, n, nulls, mean, low, high, top_values): rates of booleans, moments of numbers, top values of strings."""
    out = None
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.BooleanType, T.NumericType)):
            boolean = isinstance(f.dataType, T.BooleanType)
            x = c.cast("double")
            row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("nulls"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"))
            row = row.select(F.lit(f.name).alias("column_name"), F.lit("rate" if boolean else "number").alias("kind"), "*", F.lit(None).cast("string").alias("top_values"))
        elif isinstance(f.dataType, T.StringType):
            counts = df.groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("k"))
            named = F.concat(F.col("v"), F.lit("="), F.col("k").cast("string"))
            ranked = counts.filter("v is not null").orderBy(F.desc("k"), "v").limit(top)
            best = ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("a"), F.col("v"), named.alias("s")))), lambda x: x["s"]), ",").alias("top_values"))
            row = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("nulls")).join(F.broadcast(best))
            none = F.lit(None).cast("double")
            row = row.select(F.lit(f.name).alias("column_name"), F.lit("string").alias("kind"), "n", "nulls", none.alias("mean"), none.alias("low"), none.alias("high"), "top_values")
        else:
            continue
        out = row if out is None else out.unionByName(row)
    return out


def overflow_histogram(df: DataFrame, value: str, width: float, buckets: int) -> DataFrame:
    return df.groupBy(F.least(F.floor(F.col(value) / width), F.lit(buckets)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def rebucket(histogram: DataFrame, value: str, n: str, width: int) -> DataFrame:
    return histogram.groupBy((F.floor(F.col(value) / width) * width).cast("long").alias("bucket")).agg(F.sum(n).alias("n"))


def pivot_grid(df: DataFrame, row: str, column: str, rows: list, columns: list) -> DataFrame:
    """Counts on fixed axes, missing cells 0."""
    axis = df.sparkSession.createDataFrame([(r,) for r in rows], df.select(F.col(row).alias("axis")).schema)
    counts = df.groupBy(F.col(row).alias("axis")).pivot(column, columns).agg(F.count(F.lit(1)))
    return axis.join(counts, "axis", "left").fillna(0, [str(c) for c in columns])


def latest_counterpart(df: DataFrame, equal: list[str], unequal: str, at: str, key: str) -> DataFrame:
    """Each row with the key of the latest row that agrees on ``equal`` and differs on ``unequal``.

    The latest row by group and flag is found first, so rows meet at most one row for each flag.
    """
    last = df.groupBy(*equal, unequal).agg(F.max(F.struct(at, key)).alias("last_")).withColumnRenamed(unequal, "other_")
    met = df.join(last, equal, "left").filter(F.col("other_").isNull() | (F.col("other_") != F.col(unequal)) | F.col(unequal).isNull())
    best = met.filter(F.col("other_") != F.col(unequal)).groupBy(key).agg(F.max("last_").alias("best_"))
    return df.join(best, key, "left").withColumn("counterpart", F.col(f"best_.{key}")).drop("best_")


def top_values(df: DataFrame, value: str, first: str, k: int) -> DataFrame:
    """Most frequent values, ties by where they were first seen."""
    return df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def text_set_difference(a: DataFrame, b: DataFrame, text: str) -> DataFrame:
    """Texts in both, in one only, and the shares of each set that the other has."""
    x, y = (d.select(F.sha2(text, 256).alias("h")).distinct() for d in (a, b))
    both = x.withColumn("x", F.lit(1)).join(y.withColumn("y", F.lit(1)), "h", "full_outer").agg(F.count("x").alias("left_texts"), F.count("y").alias("right_texts"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("in_both"))
    return both.select(
        "*", (F.col("left_texts") - F.col("in_both")).alias("left_only"), (F.col("right_texts") - F.col("in_both")).alias("right_only"),
        (F.col("in_both") / F.nullif("left_texts", F.lit(0))).alias("left_overlap"), (F.col("in_both") / F.nullif("right_texts", F.lit(0))).alias("right_overlap"),
    )


def count_deltas(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    x, y = (d.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for d, n in ((a, "left_n"), (b, "right_n")))
    return x.join(y, key, "full_outer").select(key, F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n")).withColumn("delta", F.col("right_n") - F.col("left_n"))


def overlay(base: DataFrame, working: DataFrame, overrides: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(override, else working, else base; keys in only one of base and working; overrides of unknown keys)."""
    b, w, o = (d.select(key, F.col(text).alias(n)) for d, n in ((base, "b_"), (working, "w_"), (overrides, "o_")))
    joined = b.withColumn("in_b", F.lit(1)).join(w.withColumn("in_w", F.lit(1)), key, "full_outer")
    broken = joined.filter("in_b is null or in_w is null").select(key)
    merged = joined.join(o, key, "left").select(key, F.coalesce("o_", "w_", "b_").alias(text), (F.coalesce("o_", "w_", "b_") != F.col("b_")).alias("changed"))
    return merged, broken, overrides.join(base, key, "left_anti").select(key)


def basename_collisions(df: DataFrame, path: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    groups = df.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collisions")), groups.orderBy(F.desc("n"), "stem").limit(k)


def bucket_batches(df: DataFrame, size: str, key: str, batch: int, seed: int = 0, drop_last: bool = False) -> DataFrame:
    """Rows by size in buckets of ten batches, shuffled by hash within one; adds bucket and batch.

    Buckets come from an exact rank by ranges of size, so no task sees more than a bucket's neighbours.
    """
    ranked = exact_rank(df, [size, key]).withColumn("bucket", F.floor(F.col("rank") / (10 * batch)))
    within = Window.partitionBy("bucket").orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key)
    out = ranked.withColumn("batch", F.col("bucket") * 10 + F.floor((F.row_number().over(within) - 1) / batch)).drop("rank")
    if drop_last:
        full = out.groupBy("batch").count().filter(F.col("count") == batch).select("batch")
        out = out.join(full, "batch", "left_semi")
    return out


def exact_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with a zero-based ``rank`` in global order: ranges are sorted apart and shifted by their counts.

    Ranges come from a sample, so they are dealt once and kept: counts and rows must agree on them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("part_", F.spark_partition_id()).persist()
    ranged = ranged.withColumn("in_part", F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1)
    counts = ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("c"))
    shift = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(shift.select("part_", "before")), "part_").withColumn("rank", F.col("in_part") + F.col("before")).drop("part_", "in_part", "before")


def running_counts(histogram: DataFrame, value: str, n: str) -> DataFrame:
    """``histogram`` with ``upto``, the sum of ``n`` up to each value: ranges are summed apart and shifted by their totals."""
    parts = int(histogram.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = histogram.repartitionByRange(parts, value).withColumn("part_", F.spark_partition_id()).persist()
    totals = ranged.groupBy("part_").agg(F.sum(n).alias("c"))  # a row for each partition
    shift = totals.select("part_", F.coalesce(F.sum("c").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum(n).over(Window.partitionBy("part_").orderBy(value))
    return ranged.withColumn("upto", within).join(F.broadcast(shift), "part_").withColumn("upto", F.col("upto") + F.col("before")).drop("part_", "before")


def remove_rows(df: DataFrame, index: str, gone: list[int]) -> DataFrame:
    return df.filter(~F.col(index).isin(gone))


def size_violations(df: DataFrame, width: str, height: str, wanted: tuple[int, int]) -> DataFrame:
    return df.filter((F.col(width) != wanted[0]) | (F.col(height) != wanted[1]))


def cohort_summary(df: DataFrame, kept: Column, value: str) -> DataFrame:
    """(cohort, n, mean, low, high, p95) before a filter, after it, and of what it removed."""
    rows = df.select(F.explode(F.array(F.lit("before"), F.when(kept, "after").otherwise("removed"))).alias("cohort"), F.col(value).alias("v"))
    return rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile("v", 0.95).alias("p95"))


def exact_hash_split(df: DataFrame, path: str, validation: int, preview: int, seed: int) -> DataFrame:
    """``df`` with ``split`` and ``preview``: the ``validation`` rows whose SHA-256 of ``split``, seed and path (parted by
    NUL) comes first validate; of these the first ``preview`` by a hash with another salt are shown."""

    def key(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(salt), F.lit("\0"), F.lit(str(seed)), F.lit("\0"), F.col(path)), 256)

    if validation < 1 or preview < 1:
        raise ValueError("sizes must be >= 1")
    held = df.select(path).orderBy(key("split"), path).limit(validation)
    shown = held.orderBy(key("preview"), path).limit(preview).withColumn("preview", F.lit(True))
    marks = held.join(shown, path, "left").withColumn("split", F.lit("validation"))
    out = df.join(marks, path, "left")
    return out.withColumns({"split": F.coalesce("split", F.lit("train")), "preview": F.coalesce("preview", F.lit(False))})


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, by hash of seed and key."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def join_complete(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """Inner join that wants a partner for every row of ``left``; names up to five that have none."""
    absent = left.join(right.select(key), key, "left_anti").select(key).distinct().orderBy(key).limit(5).collect()
    if absent:
        raise KeyError(f"Missing {what} for: {', '.join(str(r[0]) for r in absent)}")
    return left.join(right, key)


def matched_and_unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inner join, rows of ``left`` without a partner)."""
    return left.join(right, keys), left.join(right.select(*keys).distinct(), keys, "left_anti")


def split_and_index(name: Column) -> Column:
    """STRUCT of split and idx from names like ``train_000012.krn``, null for others."""
    found = name.rlike(r"^[a-z]+_\d+\.krn$")
    return F.when(found, F.struct(F.regexp_extract(name, r"^([a-z]+)_", 1).alias("split"), F.regexp_extract(name, r"_(\d+)\.krn$", 1).cast("long").alias("idx")))


def latest_run(runs: DataFrame, name: str, pointer: str | None = None) -> Column:
    """Aggregate: the pointer's run, else the name whose numbers, in order, are greatest."""
    numbers = F.transform(F.regexp_extract_all(F.col(name), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    best = F.max_by(name, numbers)
    return F.coalesce(F.lit(pointer), best) if pointer else best


def latest_event(events: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("e")).select(key, "e.*")


def matching(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that equal every value that is wanted; a value of None wants nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def options(df: DataFrame, name: str) -> DataFrame:
    """(label, value) of the values of a column that there are, in order."""
    return df.select(F.col(name).cast("string").alias("label"), F.col(name).alias("value")).filter("value is not null").distinct().orderBy("value")
