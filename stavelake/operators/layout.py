"""Decisions of a generated sample: acceptance, truncation, retries, augmentation, image gates.  All are Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Systems of a page.
PREFERRED, REQUIRED_OVER = (5, 7), 7
LEAST_HEIGHT, LEAST_FILL = 120, 0.08
MAX_USES = 9
MASK = 0xFFFFFFFF


def low_content(height: Column, fill: Column) -> Column:
    return (height < LEAST_HEIGHT) | (fill < LEAST_FILL)


def valid_source(text: Column) -> Column:
    """No rational durations."""
    return ~text.rlike(r"\d%-?\d")


def truncation_mode(pages: Column, systems: Column) -> Column:
    return F.when((pages > 1) | (systems > REQUIRED_OVER), "required").when(systems.between(*PREFERRED), "preferred").otherwise("forbidden")


def quality_reason(rejection: Column, has_image: Column, pages: Column) -> Column:
    return F.coalesce(rejection, F.when(~has_image, "missing_image").when(pages != 1, "multi_page"))


def acceptance(rejection: Column, has_image: Column, pages: Column, systems: Column, truncated: Column) -> Column:
    """Struct of action and reason."""
    reason, required = quality_reason(rejection, has_image, pages), truncation_mode(pages, systems) == "required"
    rejected = F.coalesce(reason, F.when(required & truncated, "post_truncation_required").when(required, "truncation_required"))
    action = F.when(rejected.isNotNull(), "reject").when(truncated, "accept_with_truncation").otherwise("accept_without_truncation")
    return F.struct(action.alias("action"), rejected.alias("reason"))


def layout_rescue(rejection: Column, systems: Column, retryable: list[str]) -> Column:
    return F.coalesce(rejection.isin(*retryable, "multi_page"), F.lit(False)) & (systems <= PREFERRED[1])


def failure_reason(decision: Column, rejection: Column, attempted: Column, mode: Column) -> Column:
    return F.when(mode.isin("preferred", "required") & attempted, "truncation_exhausted").otherwise(F.coalesce(decision, rejection, F.lit("rejected")))


def augmentation_band(systems: Column, segments: Column, fill: Column, whitespace: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    tight = (systems >= 6) | (segments >= 3) | yes(fill >= 0.82) | yes(whitespace <= 0.06)
    roomy = (systems <= 3) & (segments == 1) & (fill.isNull() | (fill <= 0.60)) & (whitespace.isNull() | (whitespace >= 0.14))
    return F.when(tight, "tight").when(roomy, "roomy").otherwise("balanced")


def augmentation_outcome(branch: Column, gate: Column, accepted: Column, fallback: Column, fallback_accepted: Column) -> Column:
    return (
        F.when(branch == "none", "clean_early_exit")
        .when(~gate, "clean_gate_rejected")
        .when(accepted, "fully_augmented")
        .when(fallback & fallback_accepted, "augraphy_on_base")
        .otherwise("clean_augraphy_failed")
    )


def quality_gate(mean_luma: Column, content: Column, margin: Column, borders: Column, least_margin: float = 0.0) -> Column:
    """The first reason for which an image fails, or null; features come from outside."""
    return (
        F.when((mean_luma < 120) | (mean_luma > 252), "mean_luma")
        .when((content < 0.005) | (content > 0.35), "content_ratio")
        .when(margin < least_margin, "margins")
        .when(borders >= 3, "border_contact")
    )


def shift_gate(shift: Column, area: Column) -> Column:
    return F.when(shift > 0.08, "shift").when(area < 0.70, "area")


def sample_seed(base: Column, sample: Column) -> Column:
    return (base.bitwiseAND(MASK) * 1_000_003 + sample).bitwiseAND(MASK)


def candidate_seed(base: Column, sample: Column, candidate: Column) -> Column:
    low = lambda c: c.cast("long").bitwiseAND(MASK)
    return (low(base) * 1_000_003 + low(sample) * 97_409 + low(candidate) * 65_537).bitwiseAND(MASK)


def rescue_seed(seed: Column) -> Column:
    return seed.bitwiseAND(MASK).bitwiseXOR(F.lit(0x5F3759DF)).bitwiseAND(MASK)


def spine_class(count: Column) -> Column:
    return F.when(count <= 1, "1").when(count == 2, "2").otherwise("3_plus")


def bucket_distance(lines: Column, low: Column, center: Column, high: Column) -> Column:
    inside = F.abs(lines - center) / F.greatest(F.lit(1.0), high - low + 1.0)
    return F.when(lines < low, (low - lines).cast("double")).when(lines > high, (lines - high).cast("double")).otherwise(inside)


def fit_penalty(lines: Column, safe: Column) -> Column:
    limit = F.greatest(F.lit(1), safe)
    return F.when(safe.isNull() | (lines <= limit), 0.0).otherwise((lines - limit) / limit)


def resolve_buckets(plans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Plans (spine_class, bucket, ...) with the range of their class, else of class ``all``; ranges are a small table."""
    own = F.broadcast(ranges.select(F.col("spine_class"), "bucket", F.struct("low", "center", "high").alias("own_")))
    every = F.broadcast(ranges.filter("spine_class = 'all'").select("bucket", F.struct("low", "center", "high").alias("all_")))
    return plans.join(own, ["spine_class", "bucket"], "left").join(every, "bucket", "left").withColumn("range", F.coalesce("own_", "all_")).drop("own_", "all_")


def target_bucket(counts: DataFrame, buckets: list[int]) -> DataFrame:
    """(spine_class, bucket) with the fewest accepted samples; of equal ones the first in ``buckets``."""
    spark = counts.sparkSession
    axis = spark.createDataFrame([(b, i) for i, b in enumerate(buckets)], "bucket int, place int")
    grid = counts.select("spine_class").distinct().join(F.broadcast(axis))
    filled = grid.join(counts, ["spine_class", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.groupBy("spine_class").agg(F.min_by("bucket", F.struct("n", "place")).alias("bucket"))


def best_plans(candidates: DataFrame) -> DataFrame:
    """The candidate of each sample with the least (distance, penalty, center distance, number)."""
    key = F.struct("distance", "penalty", "center_distance", "candidate")
    return candidates.groupBy("sample").agg(F.min_by(F.struct(*[c for c in candidates.columns if c != "sample"]), key).alias("p")).select("sample", "p.*")


def layout_summary(histogram: DataFrame, value: str, n: str, p: float) -> DataFrame:
    """Weighted mean and weighted nearest rank of a histogram."""
    from pyspark.sql import Window

    total = F.sum(n).over(Window.partitionBy())
    ranked = histogram.withColumn("upto", F.sum(n).over(Window.orderBy(value))).withColumn("rank", F.greatest(F.lit(1), F.bround(total * p)))
    return ranked.agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("mean"), F.min(F.when(F.col("upto") >= F.col("rank"), F.col(value))).alias("rank_value"))


def routed_events(outcomes: DataFrame) -> DataFrame:
    """Outcome rows with the kinds of event that each gives: diagnostics, failure or success, augmentation trace."""
    kinds = F.array_compact(
        F.array(
            F.when(F.size("diagnostics") > 0, "diagnostics"),
            F.when(F.col("failure_reason").isNotNull(), "failure").otherwise("success"),
            F.when(F.col("augmentation_trace").isNotNull(), "augmentation_trace"),
        )
    )
    return outcomes.withColumn("event_kind", F.explode(kinds))


def diagnostic_rows(df: DataFrame, stderr: str, key: str) -> DataFrame:
    """(key, level, message) of each ``[Level] message`` line; lines without a level belong to the one before."""
    blocks = F.split(F.regexp_replace(F.col(stderr), r"\n(?!\[)", " "), "\n")
    found = F.explode(F.filter(F.transform(blocks, lambda b: F.struct(F.lower(F.regexp_extract(b, r"^\[(\w+)\]", 1)).alias("level"), F.trim(F.regexp_replace(b, r"^\[\w+\]", "")).alias("message"))), lambda x: x["level"] != ""))
    return df.select(key, found.alias("d")).select(key, "d.*")


def content_box(pixels: DataFrame, key: str) -> DataFrame:
    """(key, top, bottom, left_edge, right_edge) of (key, row, column) of dark pixels."""
    return pixels.groupBy(key).agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("column").alias("left_edge"), F.max("column").alias("right_edge"))


def canvas(width: Column, height: Column, content_width: Column, content_height: Column, ratio: Column, side: Column, top: Column) -> Column:
    """STRUCT of the canvas's width and height and of the place of the content: at least the image, the content with its
    margins, and the page's ratio of height to width; content is centred between the side margins."""
    need_w = F.greatest(width, content_width + 2 * side)
    need_h = F.greatest(height, content_height + 2 * top)
    whole_w = F.greatest(need_w, F.ceil(need_h / F.greatest(ratio, F.lit(1e-6))))
    whole_h = F.greatest(F.ceil(whole_w * ratio), need_h)
    centred = F.greatest(F.lit(0), F.floor((whole_w - content_width) / 2))
    left = F.least(F.greatest(centred, side), F.greatest(side, whole_w - content_width - side))
    left = F.greatest(F.lit(0), F.least(left, whole_w - content_width))
    return F.struct(whole_w.cast("long").alias("width"), whole_h.cast("long").alias("height"), F.least(top, F.greatest(F.lit(0), whole_h - content_height)).cast("long").alias("y"), left.cast("long").alias("x"))
