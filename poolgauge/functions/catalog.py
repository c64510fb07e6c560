"""The metric catalog: what every published metric is, and what it is for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from poolgauge.functions.layout import METRIC_VERSION

_GRAINS = "pool, deal, portfolio"
COLUMNS = ("metric_id", "metric_version", "definition", "method", "business_meaning", "desired_direction", "baseline", "result_location", "supported_decision", "limitation")

#: metric_id, definition, method, meaning, direction, baseline, location, decision, limitation
ENTRIES = [
    ("eligible_current_upb", "Balance of loans with a positive balance, a numeric status and no zero-balance code.", "Decimal sum of eligible rows.", "Exposure behind the rates.", "none", "reported balance", _GRAINS, "Weigh deals.", "REO and unknown states are left out."),
    ("d30_plus_rate", "Eligible balance one month or more late over eligible balance.", "Ratio of sums.", "Early delinquency.", "lower", "release rate", _GRAINS, "Watch early deterioration.", "A monthly snapshot."),
    ("d60_plus_rate", "Eligible balance two months or more late over eligible balance.", "Ratio of sums.", "Serious delinquency.", "lower", "release rate", _GRAINS, "Rank deals.", "Not a loss estimate."),
    ("d90_plus_rate", "Eligible balance three months or more late over eligible balance.", "Ratio of sums.", "Severe delinquency.", "lower", "prior period", _GRAINS, "Escalate deals.", "Later stages share one state."),
    ("d60_change_bps", "Change of the 60-day rate over one and over three observed periods.", "Lagged difference in basis points.", "Speed of deterioration.", "lower", "zero", _GRAINS, "Pick deals to look into.", "Counts observed periods, not calendar months."),
    ("d60_rate_effect_bps", "Part of the portfolio's change that a deal's own rate explains.", "Midpoint weights times change of rate.", "Performance.", "lower", "zero", "decomposition", "Tell performance from mix.", "Descriptive, not causal."),
    ("d60_mix_effect_bps", "Part of the portfolio's change that a deal's weight explains.", "Midpoint rate times change of weight.", "Composition.", "lower", "zero", "decomposition", "Tell mix from performance.", "Depends on the cohort."),
    ("current_to_d30_roll_rate", "Matched current loans that are late one step on.", "Count and balance rates.", "Inflow.", "lower", "prior period", "flow", "Watch inflow.", "Matched loans only."),
    ("d30_to_d60_roll_rate", "Matched 30-day loans that are 60 days late or more one step on.", "Count and balance rates.", "Escalation.", "lower", "prior period", "flow", "Watch escalation.", "Small cohorts move much."),
    ("cure_rate", "Matched late loans that are current one step on.", "Count and balance rates.", "Recovery.", "higher", "prior period", "flow", "Judge recovery.", "A cure may not last."),
    ("voluntary_payoff_rate", "Matched loans that leave with code 01.", "Count and balance rates.", "Prepayment.", "none", "prior period", "flow", "Separate payoff from loss.", "Follows rates and seasons."),
    ("credit_event_exit_rate", "Matched loans that leave with a code that the pool's construct calls a credit event.", "Count and balance rates by construct and period.", "Credit exits.", "lower", "prior period", "flow", "Watch credit exits.", "Code lists change over time."),
    ("actual_loss_rate", "Growth of actual loss over beginning eligible balance.", "Difference of cumulative losses.", "Realised loss.", "lower", "prior period", "flow", "Follow losses.", "Null where no loss was observed twice."),
    ("new_modification_rate", "Eligible loans modified this period.", "Count and balance rates.", "Loss mitigation.", "none", "prior period", _GRAINS, "Watch servicing.", "First period of a modification only."),
    ("assistance_share", "Eligible balance under deferral or an assistance plan.", "Union of flags over eligible balance.", "Relief in place.", "lower", "prior period", _GRAINS, "Watch relief.", "Plans differ."),
    ("pool_factor", "Reported balance over balance at issuance.", "Ratio of sums.", "Seasoning.", "none", "one", _GRAINS, "Read rates in context.", "Issuance balance of listed loans only."),
    ("weighted_average_risk_attributes", "Balance-weighted score, ratios, coupon and age of eligible loans.", "Weighted sums over known balance.", "Collateral.", "none", "issuance", _GRAINS, "Compare collateral.", "Unknown values are left out."),
    ("risk_layer_share", "Share of eligible loans and balance by number of risk layers.", "Counts and sums over the deal's total.", "Layered risk.", "lower", "issuance", "layers", "Find layered risk.", "Fixed thresholds."),
    ("loan_match_rate", "Prior rows found again one step on.", "Matched over prior rows.", "Completeness.", "higher", "one", "flow", "Trust the flow.", "Exits lower it too."),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e[0], METRIC_VERSION, *e[1:]) for e in ENTRIES], ", ".join(f"{c} string" for c in COLUMNS))
