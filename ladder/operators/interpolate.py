"""Two-tier interpolation of an outcome by a normalised spend (Q3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladder.functions.columns import lenient_double
from ladder.functions.exact import exact_mean
from ladder.functions.labels import HIGH_TIER, NORMAL_TIER, TIER_CUT
from ladder.operators.joins import attach_scalar


def tier_means(institutions: DataFrame, rate_text: str = "rate_text", cut: float = TIER_CUT,
               tier_as: str = "tier", mean_as: str = "tier_rate") -> DataFrame:
    """Mean rate per tier: rows with a non-NULL, non-empty rate text are parsed leniently (P3) and
    bucketed High (rate >= cut) or Normal (P9, A13). At most two rows."""
    t = F.col(rate_text)
    rated = institutions.where(t.isNotNull() & (t != F.lit(""))).select(lenient_double(t).alias("_rate"))
    tiered = rated.select(
        F.when(F.col("_rate") >= F.lit(cut), F.lit(HIGH_TIER)).otherwise(F.lit(NORMAL_TIER)).alias(tier_as),
        "_rate")
    return tiered.groupBy(tier_as).agg(exact_mean("_rate").alias(mean_as))


def interpolate_two_tiers(bands: DataFrame, tiers: DataFrame, band: str, spend: str,
                          tier: str = "tier", tier_rate: str = "tier_rate", spend_digits: int | None = 1,
                          digits: int | None = 1, spend_as: str | None = None,
                          expected_as: str = "expected_rate") -> DataFrame:
    """Per band: ``p = spend / MAX(spend)`` (J2), then ``p * High + (1 - p) * Normal`` with the two tier
    means attached to every band (J1). No High or no Normal tier gives an empty result, as an inner
    join on a constant predicate does. A zero maximum gives NULL.
    """
    rate = lambda name: F.max(F.when(F.col(tier) == F.lit(name), F.col(tier_rate)))
    both = tiers.agg(rate(HIGH_TIER).alias("_high"), rate(NORMAL_TIER).alias("_normal"),
                     F.count_if(F.col(tier).isin(HIGH_TIER, NORMAL_TIER)).alias("_tiers")).where("_tiers = 2")
    # The window is over the bands' aggregates, a few rows.
    with_tiers = attach_scalar(bands.withColumn("_top", F.max(spend).over(Window.partitionBy())), both.drop("_tiers"))
    p = F.try_divide(F.col(spend), F.col("_top"))
    expected = p * F.col("_high") + (F.lit(1) - p) * F.col("_normal")
    s = F.col(spend)
    return with_tiers.select(
        band,
        (F.round(s, spend_digits) if spend_digits is not None else s).alias(spend_as or spend),
        (F.round(expected, digits) if digits is not None else expected).alias(expected_as),
    )
