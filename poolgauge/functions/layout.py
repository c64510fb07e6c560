"""The positional layout of a disclosure file and the types of the stored foundation."""

from __future__ import annotations

from pyspark.sql import types as T

METRIC_VERSION = "m8.1.0"

#: Widths of a line that are accepted; shorter ones are padded on the right.
WIDTHS = (89, 90, 93)

# Field names by position, as the disclosure layout orders them.
FIELD_NAMES = tuple(
    """
    period reference_pool_number loan_identifier amortization_type seller_name property_state
    postal_code_3_digit metropolitan_statistical_area_or_division first_payment_date maturity_date
    original_loan_term original_interest_rate original_upb upb_at_issuance loan_purpose channel
    property_type number_of_units occupancy_status number_of_borrowers first_time_homebuyer_indicator
    prepayment_penalty_indicator classic_fico original_ltv original_cltv original_dti
    mortgage_insurance_percent updated_credit_score_at_issuance special_eligibility_program
    mortgage_insurance_type filler_31 disaster_grace_period servicer_name loan_age
    remaining_months_to_legal_maturity adjusted_remaining_months_to_maturity
    current_loan_delinquency_status payment_history current_interest_rate current_actual_upb
    current_interest_bearing_upb upb_at_removal zero_balance_code zero_balance_effective_date
    defect_settlement_date modification_flag delinquency_due_to_disaster ddlpi bankruptcy_flag
    foreclosure_referral_date net_sales_proceeds mi_credit taxes_and_insurance legal_costs
    maintenance_and_preservation_costs bankruptcy_cramdown_costs miscellaneous_expenses
    miscellaneous_credits mi_cancellation_indicator estimated_ltv filler_61 updated_credit_score_1
    updated_credit_score_2 number_of_modifications modification_program modification_type
    modification_first_payment_date modification_dti total_capitalized_amount
    interest_rate_step_indicator first_step_rate_adjustment_date first_step_rate
    second_step_rate_adjustment_date second_step_rate third_step_rate_adjustment_date third_step_rate
    fourth_step_rate_adjustment_date fourth_step_rate fifth_step_rate_adjustment_date fifth_step_rate
    delinquent_accrued_interest current_period_modification_costs updated_credit_score_3
    property_valuation_method group_number enhanced_relief_refi_indicator borrower_assistance_plan
    payment_deferral_flag distressed_principal_balance_flag temporary_subsidy_buydown_plan_type
    vantagescore_4 actual_loss cumulative_modification_costs
    """.split()
)

LINEAGE = ("deal_id", "source_member", "source_field_count")

FOUNDATION_SCHEMA = T.StructType(
    [T.StructField("deal_id", T.StringType()), T.StructField("source_member", T.StringType()), T.StructField("source_field_count", T.ShortType())]
    + [T.StructField(n, T.StringType()) for n in FIELD_NAMES]
)
