"""The parameterised queries of the workbench and of the public record service."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolgauge.functions.columns import display_id
from poolgauge.functions.measures import INTERNAL
from poolgauge.plans import pages
from poolgauge.plans.tables import Tables

SORTS = ("total_contribution_bps", "d60_change_1m_bps", "d60_plus_rate", "eligible_current_upb", "current_to_d30_rate_upb", "d30_to_d60_rate_upb", "credit_event_exit_rate_upb", "assistance_exposure_share", "rate_effect_bps")
STATES = {"all": None, "current": "CURRENT", "d30": "D30", "d60": "D60", "d90": "D90_PLUS", "reo": "REO", "unknown": "UNKNOWN"}
PUBLIC_STATES = ("all", "current", "d30", "d60", "d90", "reo", "zero_balance")
PRIVATE_LIMIT, PRIVATE_OFFSET = 100, 1_000_000
PUBLIC_LIMIT, PUBLIC_OFFSET = 50, 150_000


def _loan_order() -> dict[str, pages.Key]:
    late = ("risk_layer_count", "delinquency_months", "current_upb")
    return {**{c: pages.Key(F.col(c), True) for c in late}, "loan_identifier": pages.Key(F.col("loan_identifier"))}


def _public_order() -> list[pages.Key]:
    return [pages.Key(F.col("current_loan_delinquency_status").try_cast("int"), True), pages.Key(F.col("current_actual_upb").try_cast("double"), True), pages.Key(F.col("loan_identifier"))]


# The result columns of the views, in order.
_DEAL = (
    "deal_id", "reporting_period", "eligible_active_loans", "eligible_current_upb", "d60_plus_upb", "d30_plus_rate", "d60_plus_rate", "d90_plus_rate",
    "d60_change_1m_bps", "d60_change_3m_bps", "assistance_exposure_share", "new_modification_rate_count", "wa_classic_fico", "wa_original_ltv",
    "wa_original_dti",
)
_FLOW = (
    "loan_match_rate", "current_to_d30_rate_upb", "d30_to_d60_rate_upb", "cure_rate_upb", "voluntary_payoff_rate_upb", "credit_event_exit_rate_upb",
    "current_to_d30_loans", "d30_to_d60_loans", "cured_loans", "credit_event_exit_loans",
)
_EFFECTS = ("rate_effect_bps", "mix_effect_bps", "total_contribution_bps")
_ROW = (
    "reference_pool_number", "current_upb", "performance_state", "delinquency_status_raw", "zero_balance_code", "risk_layer_count",
    "classic_fico_value", "original_ltv_value", "original_cltv_value", "original_dti_value", "current_interest_rate_value", "loan_age_value",
    "origination_vintage", "loan_purpose", "channel", "occupancy_status", "property_type", "property_state", "modification_flag",
    "borrower_assistance_plan", "payment_deferral_flag", "delinquency_due_to_disaster", "servicer_name", "pool_construct",
)


class RequestError(ValueError):
    """A parameter is not of its form or range."""


def require(value: str, shape: str, what: str) -> str:
    if not isinstance(value, str) or not re.fullmatch(shape, value):
        raise RequestError(f"{what} is not valid")
    return value


def require_page(limit: int, offset: int, most: int, furthest: int) -> None:
    if not 1 <= limit <= most or not 0 <= offset <= furthest:
        raise RequestError(f"a page has 1 to {most} rows and begins at 0 to {furthest}")


def watchlist(tables: Tables, period: str | None = None, sort: str = "total_contribution_bps", descending: bool = True) -> DataFrame:
    """Deals of a period (the latest) with metrics, flow and effects, ranked by a measure; nulls last."""
    if sort not in SORTS:
        raise RequestError("sort is not valid")
    deals = tables.deal.select(*_DEAL, "metric_version")
    if period is None:
        last = tables.portfolio.agg(F.max("reporting_period").alias("last"))
        deals = deals.join(F.broadcast(last), F.col("reporting_period") == F.col("last"), "left_semi")  # one row
    else:
        deals = deals.where(F.col("reporting_period") == require(period, r"\d{6}", "period"))
    keys = ["deal_id", "reporting_period"]
    met = deals.join(tables.flow.select(*keys, *_FLOW), keys, "left").join(tables.decomposition.select(*keys, *_EFFECTS), keys, "left")
    order = [F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last(), "deal_id"]
    # one row per deal of one period
    return met.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint").alias("rank"), *_DEAL, *_FLOW, *_EFFECTS, "metric_version").orderBy("rank")


def drivers(tables: Tables, period: str) -> DataFrame:
    """A period's decomposition by size of contribution."""
    return tables.decomposition.where(F.col("reporting_period") == require(period, r"\d{6}", "period")).drop("prior_reporting_period").orderBy(F.abs("total_contribution_bps").desc(), "deal_id")


def overview(tables: Tables, period: str, sort: str = "total_contribution_bps", descending: bool = True) -> dict[str, DataFrame]:
    effects = drivers(tables, period)
    return {
        "portfolio": shown(tables.portfolio.where(F.col("reporting_period") == period)),
        "watchlist": watchlist(tables, period, sort, descending),
        "decomposition": effects,
        "decomposition_totals": effects.agg(*[F.round(F.sum(F.coalesce(c, F.lit(0.0))), 9).alias(c) for c in _EFFECTS]),
    }


def shown(metrics: DataFrame) -> DataFrame:
    """Metrics without the sums that only serve averages."""
    return metrics.drop(*INTERNAL)


def deal_series(tables: Tables, deal: str, period: str) -> DataFrame:
    return tables.deal.where((F.col("deal_id") == deal) & (F.col("reporting_period") <= period)).select("reporting_period", "d30_plus_rate", "d60_plus_rate", "d90_plus_rate", "d60_change_1m_bps", "eligible_current_upb").orderBy("reporting_period")


def pool_ranking(tables: Tables, deal: str, period: str) -> DataFrame:
    pools = tables.pool.where((F.col("deal_id") == deal) & (F.col("reporting_period") == period))
    return pools.select("reference_pool_number", "eligible_active_loans", "eligible_current_upb", "d30_plus_rate", "d60_plus_rate", "d90_plus_rate", "d60_change_1m_bps", "assistance_exposure_share", "new_modification_rate_count", "metric_version").orderBy(F.col("d60_change_1m_bps").desc_nulls_last(), "reference_pool_number")


def deal_view(tables: Tables, deal: str, period: str) -> dict[str, DataFrame]:
    require(deal, r"[A-Za-z0-9-]{1,32}", "deal")
    require(period, r"\d{6}", "period")
    here = (F.col("deal_id") == deal) & (F.col("reporting_period") == period)
    return {
        "current": shown(tables.deal.where(here)),
        "series": deal_series(tables, deal, period),
        "portfolio_series": tables.portfolio.where(F.col("reporting_period") <= period).select("reporting_period", "d60_plus_rate", "d60_change_1m_bps", "eligible_current_upb").orderBy("reporting_period"),
        "flow": tables.flow.where(here),
        "risk_layers": tables.layers.where(here).drop("deal_id", "reporting_period", "period_date").orderBy("risk_layer_count"),
        "pools": pool_ranking(tables, deal, period),
    }


def series_against_portfolio(tables: Tables, trailing: int = 18) -> DataFrame:
    """Each deal's last observations beside the portfolio's, and their difference in basis points."""
    recent = Window.partitionBy("deal_id").orderBy(F.desc("period_date"))
    deals = tables.deal.select("deal_id", "reporting_period", "d60_plus_rate", F.row_number().over(recent).alias("n")).where(F.col("n") <= trailing).drop("n")
    whole = tables.portfolio.select("reporting_period", F.col("d60_plus_rate").alias("portfolio_d60_plus_rate"))
    return deals.join(whole, "reporting_period").withColumn("difference_bps", (F.col("d60_plus_rate") - F.col("portfolio_d60_plus_rate")) * 10000)


def loan_page(rows: DataFrame, period: str, deal: str, status: str = "all", layer: int | None = None, limit: int = 50, offset: int = 0, reveal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(one-row total, page) of a deal's typed rows; the filters reach the partitions of the foundation.

    Ordered by layers, months late, balance and then by the true identifier, so
    pages are disjoint whether it is shown or not.
    """
    require_page(limit, offset, PRIVATE_LIMIT, PRIVATE_OFFSET)
    found = _loans(rows, period, deal, status, layer)
    page = found.orderBy(*[k.order(c) for c, k in _loan_order().items()]).offset(offset).limit(limit)
    return found.agg(F.count("*").alias("total")), page.select(_loan_name(reveal), *_ROW)


def loan_page_after(rows: DataFrame, period: str, deal: str, status: str = "all", layer: int | None = None, limit: int = 50, after: str | None = None, reveal: bool = False) -> DataFrame:
    """The page of :func:`loan_page` behind a cursor, with the cursor of each row (see :mod:`pages`); no depth is too deep.

    A cursor holds the true identifier: it is the service's, whoever sees the page.
    """
    require_page(limit, 0, PRIVATE_LIMIT, PRIVATE_OFFSET)
    found = _loans(rows, period, deal, status, layer).select("loan_identifier", "delinquency_months", *_ROW)
    return pages.page(found, list(_loan_order().values()), limit, after).select(_loan_name(reveal), *_ROW, "cursor")


def _loan_name(reveal: bool) -> Column:
    return (F.col("loan_identifier") if reveal else display_id("loan_identifier")).alias("loan_identifier")


def _loans(rows: DataFrame, period: str, deal: str, status: str, layer: int | None) -> DataFrame:
    require(deal, r"[A-Za-z0-9-]{1,32}", "deal")
    require(period, r"\d{6}", "period")
    if status not in STATES:
        raise RequestError("status is not valid")
    found = rows.where((F.col("reporting_period") == period) & (F.col("deal_id") == deal))
    if STATES[status]:
        found = found.where(F.col("performance_state") == STATES[status])
    if layer is not None:
        found = found.where(F.col("risk_layer_count") == layer)
    return found


def public_predicate(status: str) -> Column:
    raw = F.col("current_loan_delinquency_status")
    if status not in PUBLIC_STATES:
        raise RequestError("status is not valid")
    exact = {"current": "00", "d30": "01", "d60": "02", "reo": "RA"}
    if status in exact:
        return raw == exact[status]
    if status == "d90":
        return F.coalesce(raw.try_cast("int") >= 3, F.lit(False))
    if status == "zero_balance":
        return F.col("zero_balance_code").isNotNull() & (F.col("zero_balance_code") != "")
    return F.lit(True)


def public_page(public: DataFrame, status: str = "all", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one-row total, page of all columns) of a masked partition."""
    require_page(limit, offset, PUBLIC_LIMIT, PUBLIC_OFFSET)
    found = public.where(public_predicate(status))
    order = [k.column.desc_nulls_last() if k.descending else k.column.asc_nulls_last() for k in _public_order()]
    return found.agg(F.count("*").alias("total")), found.orderBy(*order).offset(offset).limit(limit)


def public_page_after(public: DataFrame, status: str = "all", limit: int = 50, after: str | None = None) -> DataFrame:
    """The page of :func:`public_page` behind a cursor, with the cursor of each row."""
    require_page(limit, 0, PUBLIC_LIMIT, PUBLIC_OFFSET)
    return pages.page(public.where(public_predicate(status)), _public_order(), limit, after)


def bootstrap(tables: Tables) -> dict[str, DataFrame]:
    total = tables.catalog.limit(1).select(F.lit("d60_total_contribution_bps").alias("metric_id"), "metric_version", F.lit("Signed contribution of a deal to the portfolio's change.").alias("definition"))
    return {
        "periods": tables.portfolio.select("reporting_period").orderBy(F.desc("reporting_period")),
        "deals": tables.deal.select("deal_id").distinct().orderBy("deal_id"),
        "versions": tables.portfolio.select("metric_version").distinct(),
        "catalog": tables.catalog.select("metric_id", "metric_version", "definition").unionByName(total),
    }


def evidence_package(tables: Tables, deal: str, period: str) -> dict[str, DataFrame]:
    """The deal and portfolio views without loan rows, and the controls over them."""
    from poolgauge.operators.attribution import identity_variance
    from poolgauge.operators.control import transition_audit

    one = lambda d: d.where(F.col("reporting_period") == period)
    return {**overview(tables, period), **deal_view(tables, deal, period), "identity": identity_variance(one(tables.decomposition), one(tables.portfolio)), "transitions": transition_audit(one(tables.flow))}


def findings(tables: Tables) -> DataFrame:
    """Per finding and latest period: the deal it names and the figures behind it."""
    last = F.broadcast(tables.portfolio.agg(F.max("reporting_period").alias("last")))
    now = lambda d: d.join(last, F.col("reporting_period") == F.col("last"), "left_semi")
    keys = ["deal_id", "reporting_period"]
    deals = now(tables.deal).select(*keys, "d60_plus_rate", "d60_change_1m_bps").join(now(tables.decomposition).select(*keys, "total_contribution_bps"), keys)
    flows = now(tables.flow).select(*keys, "d30_to_d60_rate_upb")
    top = lambda d, c, name: d.agg(F.max_by("deal_id", F.when(F.col(c).isNotNull(), F.struct(F.col(c), F.col("deal_id")))).alias("deal_id"), F.max(c).alias("figure")).select(F.lit(name).alias("finding"), "deal_id", "figure")
    led = now(tables.decomposition).agg(F.round(F.sum("rate_effect_bps"), 6).alias("r"), F.round(F.sum("mix_effect_bps"), 6).alias("m"))
    led = led.select(F.when(F.abs("r") >= F.abs("m"), "rate_led_change").otherwise("mix_led_change").alias("finding"), F.lit(None).cast("string").alias("deal_id"), F.col("r").alias("figure"))
    return led.unionByName(top(deals, "total_contribution_bps", "largest_contributor")).unionByName(top(deals, "d60_change_1m_bps", "largest_rate_increase")).unionByName(top(flows, "d30_to_d60_rate_upb", "highest_escalation"))
