"""Flow between adjacent periods.

Each loan's rows are ordered once and every row looks one row ahead: a loan is
matched if its next row is one step later. That is one shuffle of the panel by
loan and one aggregation; loans that are new in a period are its records less
the matched ones. :func:`pairs_by_join` is the two-join form, kept to test
against.

Defined cases: a row without deal, pool or loan id matches nothing, as in a
join on equal keys, and such rows are dealt out by their hash instead of
meeting in one group. (deal, pool, loan, period) is unique: the gates of the
store refuse repeated ones, which :func:`totals` counts as it goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolgauge.functions.columns import period_of, shifted
from poolgauge.functions.layout import METRIC_VERSION
from poolgauge.functions.measures import CREDIT_CUTOVER, FLOW_RATES, LOSS_INCREMENT, aggregate, flow_measures
from poolgauge.operators.components import ratios

LOAN = ("deal_id", "reference_pool_number", "loan_identifier")
_AHEAD = ("current_upb", "delinquency_months", "zero_balance_code", "removal_upb", "modification_flag", "payment_deferral_flag", "actual_loss", "pool_construct", "performance_state")
_PRIOR = {"current_upb": "prior_upb", "delinquency_months": "prior_delinquency_months", "zero_balance_code": "prior_zero_balance_code", "actual_loss": "prior_actual_loss", "performance_state": "prior_state"}


def observed_dates(rows: DataFrame) -> DataFrame:
    """deal_id and the dates it was observed on; one row per deal and period."""
    return rows.select("deal_id", "period_date").distinct()


def _ahead(rows: DataFrame) -> DataFrame:
    """Rows with ``next`` (the loan's following row; null without ids) and ``again`` (the loan was in the same period before)."""
    named = F.lit(True)
    for c in LOAN:
        named = named & F.col(c).isNotNull()
    lone = F.when(~named, F.xxhash64("period_date", *_AHEAD)).alias("lone")
    # sorted by the loan first: texts are told apart by their first bytes, which a deal's rows share
    order = Window.partitionBy(*reversed(LOAN), "lone").orderBy("period_date")
    needed = rows.select(*LOAN, "period_date", *_AHEAD, lone)
    again = F.coalesce(F.lag("period_date").over(order) == F.col("period_date"), F.lit(False)) & F.col("lone").isNull()
    return needed.select("*", F.when(F.col("lone").isNull(), F.lead(F.struct("period_date", *_AHEAD)).over(order)).alias("next"), again.alias("again"))


def pairs(rows: DataFrame, step: str = "month", dates: DataFrame | None = None) -> DataFrame:
    """Prior rows whose deal was observed one step later, with the loan's row there if it has one.

    ``dates``: deal_id and period_date of what was observed, if a table knows them.
    """
    later = (observed_dates(rows) if dates is None else dates).select(F.col("deal_id").alias("d_id"), F.col("period_date").alias("cur_date"))
    met = _ahead(rows).withColumn("cur", shifted(F.col("period_date"), 1, step)).join(later, (F.col("deal_id") == F.col("d_id")) & (F.col("cur") == F.col("cur_date")))
    return _moved(met, step)


def _moved(met: DataFrame, step: str) -> DataFrame:
    """Rows of :func:`_ahead` with ``cur_date``, the date one step later, as pairs."""
    matched = F.coalesce(F.col("next.period_date") == F.col("cur_date"), F.lit(False))
    return met.select(
        *LOAN,
        period_of(F.col("cur_date"), step).alias("reporting_period"),
        F.col("cur_date").alias("period_date"),
        *[F.col(c).alias(n) for c, n in _PRIOR.items()],
        matched.alias("is_matched"),
        *[F.when(matched, F.col("next")[c]).alias(c) for c in _AHEAD],
        "again",
    )


def pairs_by_join(rows: DataFrame, step: str = "month") -> DataFrame:
    """The same pairs by joining the panel with itself."""
    dates = observed_dates(rows)
    later = dates.select(F.col("deal_id").alias("d_id"), F.col("period_date").alias("cur_date"))
    prior = rows.select(*LOAN, F.col("period_date").alias("prior_date"), *[F.col(c).alias(n) for c, n in _PRIOR.items()])
    prior = prior.join(later, (F.col("deal_id") == F.col("d_id")) & (shifted(F.col("prior_date"), 1, step) == F.col("cur_date"))).drop("d_id")
    now = rows.select(*[F.col(c).alias(f"n_{c}") for c in LOAN], F.col("period_date").alias("n_date"), *_AHEAD)
    on = [F.col(c) == F.col(f"n_{c}") for c in LOAN] + [F.col("cur_date") == F.col("n_date")]
    met = prior.join(now, on, "left")
    return met.select(*LOAN, period_of(F.col("cur_date"), step).alias("reporting_period"), F.col("cur_date").alias("period_date"), *_PRIOR.values(), F.col("n_date").isNotNull().alias("is_matched"), *_AHEAD)


def observed(rows: DataFrame) -> DataFrame:
    """deal_id, period_date and records of each deal and period."""
    return rows.groupBy("deal_id", "period_date").agg(F.count("*").alias("records"))


def totals(rows: DataFrame, step: str = "month", cutover: str = CREDIT_CUTOVER, seen: DataFrame | None = None, by_join: bool = False) -> DataFrame:
    """Measures per deal and period, ``new_records``, and ``repeated_records`` for the gate. ``seen``: as :func:`observed`, if a table knows it.

    Without ``seen`` the panel is read once: rows are summed as if each deal were
    observed one step later, and sums that no such period follows are dropped.
    What follows has its records as its own prior ones.
    """
    alone = seen is None and not by_join
    if alone:
        found = _moved(_ahead(rows).withColumn("cur_date", shifted(F.col("period_date"), 1, step)), step)
    else:
        seen = observed(rows) if seen is None else seen
        found = pairs_by_join(rows, step).withColumn("again", F.lit(False)) if by_join else pairs(rows, step, seen.select("deal_id", "period_date"))
    name, value, when = LOSS_INCREMENT
    increment = F.sum(F.when(F.expr(when), F.expr(value))).cast("decimal(24,2)").alias(name)
    sums = found.groupBy("deal_id", "reporting_period", "period_date").agg(*[aggregate(m) for m in flow_measures(cutover)], increment, F.count_if("again").alias("repeated_records"))
    if alone:
        after = F.lead(F.struct("period_date", F.col("prior_records").alias("records"))).over(Window.partitionBy("deal_id").orderBy("period_date"))  # one row per deal and period
        met = sums.where("deal_id IS NOT NULL").select("*", after.alias("after")).where(F.col("after.period_date") == shifted(F.col("period_date"), 1, step))
        return met.select(*sums.columns, (F.col("after.records") - F.col("matched_records")).alias("new_records"))
    met = sums.join(seen, ["deal_id", "period_date"])
    return met.select(*sums.columns, (F.col("records") - F.col("matched_records")).alias("new_records"))


def measured(sums: DataFrame) -> DataFrame:
    """:func:`totals` with rates, as the flow table has them."""
    return sums.drop("repeated_records").select("*", *ratios(FLOW_RATES), F.lit(METRIC_VERSION).alias("metric_version"))


def flow_metrics(rows: DataFrame, step: str = "month", cutover: str = CREDIT_CUTOVER, by_join: bool = False) -> DataFrame:
    """Counts, balances and rates of movement per deal and period."""
    return measured(totals(rows, step, cutover, by_join=by_join))


def prior_row_classes(rows: DataFrame, step: str = "month") -> DataFrame:
    """How many prior rows were matched, left with a code, or left without one; and new rows. One row per class."""
    sums = totals(rows, step).agg(F.sum("matched_records").alias("matched"), F.sum("approved_exit_records").alias("approved_exit"), F.sum("error_unmatched_records").alias("error_unmatched"), F.sum("new_records").alias("new"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("row_class"), F.coalesce(k, F.lit(0)).alias("records")) for k in ("matched", "approved_exit", "error_unmatched", "new")])).alias("x")
    return sums.select(kinds).select("x.*").where((F.col("records") > 0) | (F.col("row_class") == "new"))


def transition_matrix(rows: DataFrame, step: str = "month") -> DataFrame:
    """Matched loans by state before and after.

    A matched loan's next row shows that its deal was observed there, so the
    panel is read once, for the loans; rows without ids match nothing.
    """
    named = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in LOAN))
    found = _ahead(named).withColumn("cur_date", shifted(F.col("period_date"), 1, step))
    moved = _moved(found, step).where("is_matched").groupBy("prior_state", F.col("performance_state").alias("state"))
    return moved.agg(F.count("*").alias("loans"), F.coalesce(F.sum("prior_upb"), F.lit(0)).cast("decimal(24,2)").alias("prior_upb"))
