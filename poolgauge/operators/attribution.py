"""Exact rate and mix attribution of the portfolio's change in the 60-day rate to deals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolgauge.functions.columns import ratio
from poolgauge.functions.layout import METRIC_VERSION


def decomposition(deals: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Midpoint effects of every deal seen in a portfolio period or the one before it.

    Works on metric tables (a row per deal and period); a deal that enters or
    leaves takes the rate of the side on which it was seen.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("period_date")  # one row per portfolio period
    periods = portfolio.select("reporting_period", F.lag("reporting_period").over(order).alias("prior_reporting_period"), F.col("eligible_current_upb").cast("double").alias("current_portfolio_upb"), F.lag(F.col("eligible_current_upb").cast("double")).over(order).alias("prior_portfolio_upb"))
    spans = periods.where(F.col("prior_reporting_period").isNotNull())
    at = deals.select("deal_id", F.col("reporting_period").alias("at"), F.col("eligible_current_upb").cast("double").alias("upb"), F.col("d60_plus_rate").alias("rate"))
    # each deal row meets the span it ends and the span it begins; both meet again by deal: no product of periods and deals
    ends = at.join(spans, F.col("at") == F.col("reporting_period")).select("deal_id", *spans.columns, F.col("upb").alias("cu"), F.col("rate").alias("cr"), F.lit(None).cast("double").alias("pu"), F.lit(None).cast("double").alias("pr"))
    begins = at.join(spans, F.col("at") == F.col("prior_reporting_period")).select("deal_id", *spans.columns, F.lit(None).cast("double").alias("cu"), F.lit(None).cast("double").alias("cr"), F.col("upb").alias("pu"), F.col("rate").alias("pr"))
    met = ends.unionByName(begins).groupBy("deal_id", *spans.columns).agg(*[F.max(c).alias(c) for c in ("cu", "cr", "pu", "pr")])
    sides = met.select(
        "reporting_period",
        "prior_reporting_period",
        "deal_id",
        F.coalesce("cu", F.lit(0.0)).alias("current_upb"),
        F.coalesce("pu", F.lit(0.0)).alias("prior_upb"),
        ratio(F.coalesce("cu", F.lit(0.0)), F.col("current_portfolio_upb")).alias("current_weight"),
        ratio(F.coalesce("pu", F.lit(0.0)), F.col("prior_portfolio_upb")).alias("prior_weight"),
        F.coalesce("cr", "pr", F.lit(0.0)).alias("current_rate"),
        F.coalesce("pr", "cr", F.lit(0.0)).alias("prior_rate"),
    )
    w1, w0, r1, r0 = (F.col(c) for c in ("current_weight", "prior_weight", "current_rate", "prior_rate"))
    return sides.select(
        "*",
        (0.5 * (w1 + w0) * (r1 - r0) * 10000).alias("rate_effect_bps"),
        (0.5 * (r1 + r0) * (w1 - w0) * 10000).alias("mix_effect_bps"),
        ((w1 * r1 - w0 * r0) * 10000).alias("total_contribution_bps"),
        F.lit(METRIC_VERSION).alias("metric_version"),
    )


def decomposition_totals(effects: DataFrame) -> DataFrame:
    """Sums of effects per period, rounded because sums of doubles depend on their order."""
    return effects.groupBy("reporting_period").agg(*[F.round(F.sum(c), 9).alias(c) for c in ("rate_effect_bps", "mix_effect_bps", "total_contribution_bps")])


def identity_variance(effects: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Per period, what the effects leave unexplained of the portfolio's change (rounding aside, zero)."""
    total = effects.groupBy("reporting_period").agg(F.sum(F.col("rate_effect_bps") + F.col("mix_effect_bps")).alias("explained"))
    met = total.join(portfolio.select("reporting_period", "d60_change_1m_bps"), "reporting_period")
    return met.select("reporting_period", F.round(F.abs(F.col("explained") - F.col("d60_change_1m_bps")), 6).alias("variance_bps"))
