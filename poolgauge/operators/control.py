"""The independent control path and its reconciliation with the metrics, and the gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolgauge.functions.layout import METRIC_VERSION


class GateError(ValueError):
    """A quality gate found what it forbids."""


def release_aggregate(foundation: DataFrame) -> DataFrame:
    """Records, balance and delinquent balance per period, deal and pool, straight from source strings.

    Thousands commas are dropped, an empty balance is zero and an empty status
    ``XX``, as intake has it; nothing of the typed view is used.
    """
    text = F.regexp_replace(F.coalesce("current_actual_upb", F.lit("")), ",", "")
    upb = F.coalesce(F.nullif(F.trim(text), F.lit("")).try_cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
    raw = F.coalesce(F.nullif(F.trim("current_loan_delinquency_status"), F.lit("")), F.lit("XX"))
    months = F.when(~raw.isin("RA", "XX"), raw.try_cast("int"))
    rows = foundation.select(F.col("period").alias("reporting_period"), "deal_id", "reference_pool_number", upb.alias("u"), raw.alias("s"), months.alias("m"))
    late = lambda n: F.coalesce(F.sum(F.when(F.col("m") >= n, F.col("u"))), F.lit(0)).cast("decimal(24,2)")
    out = rows.groupBy("reporting_period", "deal_id", "reference_pool_number").agg(
        F.sum("u").cast("decimal(24,2)").alias("current_upb"),
        late(1).alias("d30_plus_upb"),
        late(2).alias("d60_plus_upb"),
        F.count("*").alias("records_aggregated"),
        F.count_if(F.col("s") == "RA").alias("ra_records"),
        F.count_if(F.col("s") == "XX").alias("xx_records"),
    )
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c).cast("double"), F.nullif(F.col("current_upb").cast("double"), F.lit(0.0))), F.lit(0.0)), 10)
    return out.select("*", rate("d30_plus_upb").alias("d30_plus_rate"), rate("d60_plus_upb").alias("d60_plus_rate"))


def reconciliation(pools: DataFrame, release: DataFrame) -> DataFrame:
    """Metrics against the release, both sides kept; variances are null where a side is missing."""
    keys = ("reporting_period", "deal_id", "reference_pool_number")
    m = pools.select(*[F.col(k).alias(f"m_{k}") for k in keys], *[F.col(c).alias(f"m_{c}") for c in ("reported_current_upb", "d30_plus_upb", "d60_plus_upb", "release_compatible_d30_plus_rate", "release_compatible_d60_plus_rate", "in_scope_records")])
    r = release.select(F.col("reporting_period").cast("string").alias("r_reporting_period"), *[F.col(k).alias(f"r_{k}") for k in keys[1:]], *[F.col(c).alias(f"r_{c}") for c in ("current_upb", "d30_plus_upb", "d60_plus_upb", "d30_plus_rate", "d60_plus_rate", "records_aggregated")])
    met = m.join(r, [F.col(f"m_{k}") == F.col(f"r_{k}") for k in keys], "full_outer")
    # adding zero leaves no negative one
    gap = lambda a, b, n: F.round(F.round(F.col(a).cast("double"), n) - F.round(F.col(b).cast("double"), n), 9) + F.lit(0.0)
    return met.select(
        *[F.coalesce(f"m_{k}", f"r_{k}").alias(k) for k in keys],
        gap("m_reported_current_upb", "r_current_upb", 2).alias("current_upb_variance"),
        gap("m_d30_plus_upb", "r_d30_plus_upb", 2).alias("d30_plus_upb_variance"),
        gap("m_d60_plus_upb", "r_d60_plus_upb", 2).alias("d60_plus_upb_variance"),
        gap("m_release_compatible_d30_plus_rate", "r_d30_plus_rate", 8).alias("d30_plus_rate_variance"),
        gap("m_release_compatible_d60_plus_rate", "r_d60_plus_rate", 8).alias("d60_plus_rate_variance"),
        (F.col("m_in_scope_records") - F.col("r_records_aggregated")).alias("record_variance"),
        (F.col("m_reporting_period").isNull() | F.col("r_reporting_period").isNull()).alias("missing_group"),
        F.lit(METRIC_VERSION).alias("metric_version"),
    )


VARIANCES = ("current_upb_variance", "d30_plus_upb_variance", "d60_plus_upb_variance", "d30_plus_rate_variance", "d60_plus_rate_variance", "record_variance")


def reconciliation_summary(found: DataFrame) -> DataFrame:
    """One row: groups, the largest variances, and groups that one side lacks."""
    return found.agg(F.count("*").alias("groups"), *[F.max(F.abs(F.col(v).cast("double"))).alias(f"max_{v}") for v in VARIANCES], F.count_if("missing_group").alias("missing_groups"))


def input_gate_counts(rows: DataFrame) -> DataFrame:
    """One row of counters over the typed view: all but ``records`` have to be zero."""
    return rows.agg(F.count("*").alias("records"), *input_gates())


def input_gates() -> list[Column]:
    """The counters of :func:`input_gate_counts` that have to be zero."""
    upb, status = F.col("current_upb"), F.col("delinquency_status_raw")
    return [
        F.count_if(upb.isNull() | (upb < 0)).alias("invalid_upb"),
        F.count_if(F.col("delinquency_months").isNull() & ~status.isin("RA", "XX")).alias("invalid_status"),
        F.count_if(F.col("pool_construct") == "unknown").alias("unknown_construct"),
    ]


def transition_audit(flow: DataFrame) -> DataFrame:
    """One row of totals over the flow table."""
    names = ("prior_records", "matched_records", "approved_exit_records", "revision_exception_records", "error_unmatched_records", "new_records")
    return flow.agg(*[F.sum(n).cast("bigint").alias(n) for n in names], F.min("loan_match_rate").alias("minimum_deal_period_match_rate"))


def gate(name: str, one_row: DataFrame, passes) -> dict:
    """Collect a one-row frame and raise :class:`GateError` unless it passes."""
    row = one_row.first().asDict()
    if not passes(row):
        raise GateError(f"{name}: {row}")
    return row


def check_reconciliation(summary: DataFrame, groups: int) -> dict:
    """Balances and records agree exactly. Rates, which a release rounds to ten digits and the comparison to eight, agree but for a unit of the eighth."""
    most = lambda v: 1.5e-8 if v.endswith("_rate_variance") else 0
    return gate("reconciliation", summary, lambda r: r["groups"] == groups and not r["missing_groups"] and all((r[f"max_{v}"] or 0) <= most(v) for v in VARIANCES))


def check_inputs(counts: DataFrame, records: int | None = None) -> dict:
    return gate("inputs", counts, lambda r: not (r["invalid_upb"] or r["invalid_status"] or r["unknown_construct"]) and records in (None, r["records"]))


def check_transitions(audit: DataFrame, most: int | None = 0) -> dict:
    """At most so many loans are gone without a code; any number if None."""
    return gate("transitions", audit, lambda r: most is None or (r["error_unmatched_records"] or 0) <= most)


def check_unique(flow_totals: DataFrame) -> dict:
    """No loan twice in a pool, deal and period (``repeated_records`` of the flow's totals)."""
    return gate("unique loans", flow_totals.agg(F.coalesce(F.sum("repeated_records"), F.lit(0)).alias("repeated_records")), lambda r: not r["repeated_records"])


def check_append_only(diff: DataFrame) -> dict:
    """An offer keeps all that is committed: nothing missing, nothing changed; the counts by change."""
    counts = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
    if counts.get("missing") or counts.get("changed"):
        raise GateError(f"append only: {counts}")
    return counts


def check_identity(variance: DataFrame, limit: float = 0.01) -> dict:
    found = variance.agg(F.max("variance_bps").alias("maximum_variance_bps"))
    return gate("decomposition", found, lambda r: r["maximum_variance_bps"] is not None and r["maximum_variance_bps"] <= limit)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that several rows share, with how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def duplicate_candidates(members: DataFrame) -> DataFrame:
    """Members of a (deal, period) that several members claim; all of them are refused."""
    return members.withColumn("candidates", F.count("*").over(Window.partitionBy("deal_id", "reporting_period"))).where(F.col("candidates") > 1)


def period_gaps(periods: DataFrame) -> DataFrame:
    """Months between the first and the last observed one that were not observed. ``periods``: distinct period_date."""
    span = periods.agg(F.min("period_date").alias("a"), F.max("period_date").alias("b")).where(F.col("a").isNotNull())
    every = span.select(F.explode(F.sequence(F.col("a"), F.col("b"), F.expr("interval 1 month"))).alias("period_date"))
    return every.join(periods, "period_date", "left_anti").select(F.date_format("period_date", "yyyyMM").alias("missing_period"))


def field_profile(foundation: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Non-null count and share of each field: one scan, then the one row is turned."""
    counts = foundation.agg(F.count("*").alias("records"), *[F.count(c).alias(c) for c in fields])
    long = counts.unpivot("records", list(fields), "field_name", "non_null")
    return long.select("field_name", "records", "non_null", F.round(F.try_divide(F.col("non_null").cast("double"), F.col("records").cast("double")), 8).alias("non_null_rate"))


def fingerprint(table: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Rows and an order-free hash of a table up to a period."""
    rows = table if cutoff is None else table.where(F.col("reporting_period") <= cutoff)
    return rows.agg(F.count("*").alias("records"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(table.columns))), F.lit(0)).alias("fingerprint"))


def append_only_diff(committed: DataFrame, offered: DataFrame) -> DataFrame:
    """Keys (deal_id, reporting_period) by what an offered inventory does to the committed one: missing, changed or new."""
    keys = ["deal_id", "reporting_period"]
    facts = [c for c in committed.columns if c not in keys]
    other = offered.withColumnsRenamed({c: f"o_{c}" for c in facts})
    missing = committed.join(offered, keys, "left_anti").select(*keys, F.lit("missing").alias("change"))
    fresh = offered.join(committed, keys, "left_anti").select(*keys, F.lit("new").alias("change"))
    differs = ~F.col(facts[0]).eqNullSafe(F.col(f"o_{facts[0]}"))
    for c in facts[1:]:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"o_{c}"))
    changed = committed.join(other, keys).where(differs).select(*keys, F.lit("changed").alias("change"))
    return missing.unionByName(changed).unionByName(fresh)
