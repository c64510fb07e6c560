"""The typed view of the panel: fail-safe casts and derived columns, lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolgauge.functions.columns import between_or_null, dec, digits, month_start, whole

PASSED = ("zero_balance_code", "modification_flag", "borrower_assistance_plan", "payment_deferral_flag", "delinquency_due_to_disaster", "distressed_principal_balance_flag")
ATTRIBUTES = ("loan_purpose", "channel", "occupancy_status", "property_type", "property_state", "seller_name", "servicer_name")

# The values that scores and ratios may have.
BOUNDS = {"classic_fico": (300, 850), "original_ltv": (1, 998), "original_cltv": (1, 998), "original_dti": (1, 65)}


def typed(foundation: DataFrame, step: str = "month") -> DataFrame:
    """Typed loan-period rows of source strings.

    ``step='day'`` reads an eight-digit period as a day, for daily panels.
    """
    status = F.col("current_loan_delinquency_status")
    day = F.when(F.col("period").rlike(r"^[0-9]{8}\z"), F.try_to_timestamp("period", F.lit("yyyyMMdd")).cast("date"))
    given = lambda n: F.nullif(F.col(n), F.lit("999")).try_cast("decimal(10,4)")
    cast = foundation.select(
        "deal_id",
        "source_member",
        "source_field_count",
        F.col("period").alias("reporting_period"),
        (month_start(F.col("period")) if step == "month" else day).alias("period_date"),
        "reference_pool_number",
        "loan_identifier",
        dec("current_actual_upb").alias("current_upb"),
        dec("upb_at_issuance").alias("issuance_upb"),
        dec("upb_at_removal").alias("removal_upb"),
        digits(status, 2).alias("delinquency_months"),
        status.alias("delinquency_status_raw"),
        *PASSED,
        dec("actual_loss").alias("actual_loss"),
        dec("cumulative_modification_costs").alias("cumulative_modification_costs"),
        whole("classic_fico").alias("classic_fico_value"),
        *[given(n).alias(f"{n}_value") for n in ("original_ltv", "original_cltv", "original_dti")],
        dec("current_interest_rate", 10, 5).alias("current_interest_rate_value"),
        whole("loan_age").alias("loan_age_value"),
        F.when(F.col("first_payment_date").rlike(r"^[0-9]{6}\z"), F.left("first_payment_date", F.lit(4))).alias("origination_vintage"),
        *ATTRIBUTES,
    )
    # a second projection, so that a value is cast once however often its bounds look at it
    cast = cast.withColumns({f"{n}_value": between_or_null(F.col(f"{n}_value"), *bounds) for n, bounds in BOUNDS.items()})
    months = F.col("delinquency_months")
    state = F.when(months == 0, "CURRENT").when(months == 1, "D30").when(months == 2, "D60").when(months >= 3, "D90_PLUS").when(F.col("delinquency_status_raw") == "RA", "REO").otherwise("UNKNOWN")
    flag = F.col("distressed_principal_balance_flag")
    construct = F.when(flag.isin("Y", "N"), "actual_loss").when(flag == "9", "fixed_severity").otherwise("unknown")
    occupancy = F.col("occupancy_status")
    known = F.col("classic_fico_value").isNotNull() & F.col("original_ltv_value").isNotNull() & F.col("original_dti_value").isNotNull() & occupancy.isin("P", "S", "I")
    layers = [F.col("classic_fico_value") < 680, F.col("original_ltv_value") > 90, F.col("original_dti_value") > 45, occupancy.isin("S", "I")]
    return cast.withColumns(
        {
            "performance_state": state,
            "is_eligible_active": (F.col("current_upb") > 0) & F.col("zero_balance_code").isNull() & months.isNotNull(),
            "pool_construct": construct,
            "risk_layer_count": F.when(known, sum((x.cast("int") for x in layers[1:]), layers[0].cast("int"))),
        }
    )
