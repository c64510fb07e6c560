"""Additive components at pool, deal and portfolio grain, and the metrics over them.

Rates are never averaged: every grain sums the components of the one below,
so the panel is scanned and shuffled once, and the rest works on one row per
pool and period.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from poolgauge.functions.columns import ratio
from poolgauge.functions.layout import METRIC_VERSION
from poolgauge.functions.measures import COMPONENTS, KINDS, RATIOS, in_halves, with_halves
from poolgauge.storage import cut

POOL = ("deal_id", "reference_pool_number")
DEAL = ("deal_id",)
PORTFOLIO: tuple[str, ...] = ()
PERIOD = ("reporting_period", "period_date")


def pool_components(rows: DataFrame) -> DataFrame:
    return with_halves(rows, COMPONENTS).groupBy(*POOL, *PERIOD).agg(*[in_halves(m) for m in COMPONENTS])


def rolled_up(components: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Components of a coarser grain."""
    return components.groupBy(*keys, *PERIOD).agg(*[F.sum(n).cast(KINDS[kind]).alias(n) for n, kind, _, _ in COMPONENTS])


def deal_components(rows: DataFrame) -> DataFrame:
    return rolled_up(pool_components(rows), DEAL)


def portfolio_components(rows: DataFrame) -> DataFrame:
    return rolled_up(deal_components(rows), PORTFOLIO)


def ratios(specs: list[tuple[str, str, str]]) -> list[Column]:
    return [ratio(F.col(a), F.col(b)).alias(n) for n, a, b in specs]


def metrics(components: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Ratios, and the change of the 60-day rate over one and three observed periods.

    Without keys the window has one partition: it holds one row per period.
    """
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("period_date")
    return levels(components).select("*", *changes(order))


#: Rows behind a row that its changes look at.
LAGS = {"d60_change_1m_bps": 1, "d60_change_3m_bps": 3}


def levels(components: DataFrame) -> DataFrame:
    """Components with their ratios."""
    return components.select("*", *ratios(RATIOS), F.lit(METRIC_VERSION).alias("metric_version"))


def changes(order: WindowSpec) -> list[Column]:
    return [((F.col("d60_plus_rate") - F.lag("d60_plus_rate", n).over(order)) * 10000).alias(c) for c, n in LAGS.items()]


def extended(history: DataFrame, fresh: DataFrame, keys: tuple[str, ...], known: set[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Metrics of the periods that new components touch, and those periods; ``known``: the history's periods, if a store knows them.

    Only what a change looks at is read of the history: rates of the entities
    that have new rows. A new row touches the rows up to three behind it, which
    a late one has; all other rows of touched periods are taken as they are.
    """
    new = levels(fresh)
    narrow = [*keys, *PERIOD, "d60_plus_rate"]
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    old = history.select(*narrow).alias("h").join(new.select(*keys).distinct().alias("n"), same("h", "n"), "left_semi")
    order = Window.partitionBy(*keys).orderBy("period_date")
    both = old.withColumn("is_new", F.lit(False)).unionByName(new.select(*narrow).withColumn("is_new", F.lit(True)))
    moved = both.select(*keys, "reporting_period", "is_new", *changes(order), F.max("is_new").over(order.rowsBetween(-max(LAGS.values()), 0)).alias("moves")).where("moves").drop("moves")
    moved = cut(moved)
    periods = [r[0] for r in moved.select("reporting_period").distinct().collect()]  # at most one per period of the panel
    met = same("h", "m") & (F.col("h.reporting_period") == F.col("m.reporting_period"))
    rest = [c for c in history.columns if c not in LAGS]
    if known is not None and not known & set(periods):
        return new.alias("h").join(moved.alias("m"), met).select(*[F.col(f"h.{c}") for c in rest], *[F.col(f"m.{c}") for c in LAGS]), periods
    kept = history.where(F.col("reporting_period").isin(periods)).alias("h")
    untouched = kept.join(moved.alias("m"), met, "left_anti")
    shifted = kept.join(moved.where("NOT is_new").alias("m"), met).select(*[F.col(f"h.{c}") for c in rest], *[F.col(f"m.{c}") for c in LAGS])
    added = new.alias("h").join(moved.where("is_new").alias("m"), met).select(*[F.col(f"h.{c}") for c in rest], *[F.col(f"m.{c}") for c in LAGS])
    return untouched.unionByName(shifted).unionByName(added), periods


def pool_metrics(rows: DataFrame) -> DataFrame:
    return metrics(pool_components(rows), POOL)


def deal_metrics(rows: DataFrame) -> DataFrame:
    return metrics(deal_components(rows), DEAL)


def portfolio_metrics(rows: DataFrame) -> DataFrame:
    return metrics(portfolio_components(rows), PORTFOLIO)


def risk_layers(rows: DataFrame) -> DataFrame:
    """Loans and balance of eligible loans by number of risk layers, and each layer's share of its deal and period.

    Rows are chosen within the sums: as a filter, the choice would be moved below
    the typing and repeat it, in code too long for the JVM to compile.
    """
    counted = F.coalesce(F.col("is_eligible_active") & F.col("risk_layer_count").isNotNull(), F.lit(False))
    grouped = (
        rows.groupBy(*DEAL, *PERIOD, "risk_layer_count")
        .agg(F.count_if(counted).alias("eligible_loans"), F.sum(F.when(counted, F.col("current_upb"))).cast("decimal(24,2)").alias("eligible_current_upb"))
        .where(F.col("eligible_loans") > 0)
    )
    return layer_shares(grouped)


def layer_sums() -> list[Column]:
    """What :func:`risk_layers` groups, as sums beside others: ``layer_<n>_loans`` and ``layer_<n>_upb`` for each of the layers 0 to 4."""
    met = lambda n: F.coalesce(F.col("is_eligible_active") & (F.col("risk_layer_count") == n), F.lit(False))
    return [a for n in range(5) for a in (F.count_if(met(n)).alias(f"layer_{n}_loans"), F.sum(F.when(met(n), F.col("current_upb"))).cast("decimal(24,2)").alias(f"layer_{n}_upb"))]


def layers_of_sums(sums: DataFrame) -> DataFrame:
    """:func:`risk_layers` from rows by deal and period with :func:`layer_sums`."""
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("risk_layer_count"), F.col(f"layer_{n}_loans").alias("eligible_loans"), F.col(f"layer_{n}_upb").alias("eligible_current_upb")) for n in range(5)]))
    return layer_shares(sums.select(*DEAL, *PERIOD, each).where(F.col("eligible_loans") > 0))


def layer_shares(grouped: DataFrame) -> DataFrame:
    whole = Window.partitionBy("deal_id", "reporting_period")
    share = lambda c: F.col(c).cast("double") / F.sum(c).over(whole).cast("double")
    return grouped.select("*", share("eligible_loans").alias("loan_share"), share("eligible_current_upb").alias("upb_share"), F.lit(METRIC_VERSION).alias("metric_version"))


def risk_layers_dense(layers: DataFrame) -> DataFrame:
    """All five layers of every deal and period, zero where none was seen."""
    keys = layers.select(*DEAL, *PERIOD).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("risk_layer_count"))
    seen = layers.select(*DEAL, "reporting_period", "risk_layer_count", "eligible_loans", "eligible_current_upb", "loan_share", "upb_share")
    met = keys.join(seen, [*DEAL, "reporting_period", "risk_layer_count"], "left")
    return met.fillna(0, ["eligible_loans", "loan_share", "upb_share"]).withColumn("eligible_current_upb", F.coalesce("eligible_current_upb", F.lit(0).cast("decimal(24,2)")))
