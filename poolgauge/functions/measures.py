"""Measures declared once as data: name, kind, value, predicate.

Kinds: ``count`` of rows, ``sum`` as decimal(24,2), ``weighted`` sum as
decimal(30,4), ``present`` (count of non-null values). The predicates are
plain SQL that any engine reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = "is_eligible_active"
KINDS = {"count": "bigint", "present": "bigint", "sum": "decimal(24,2)", "weighted": "decimal(30,4)"}

_KNOWN = {"fico": "classic_fico_value", "ltv": "original_ltv_value", "cltv": "original_cltv_value", "dti": "original_dti_value", "coupon": "current_interest_rate_value", "loan_age": "loan_age_value"}
_DEFERRED = "payment_deferral_flag IN ('C','P')"
_ASSISTED = "borrower_assistance_plan IN ('F','R','T')"


def _pair(name: str, when: str) -> list[tuple]:
    return [(f"{name}_loans", "count", None, when), (f"{name}_upb", "sum", "current_upb", when)]


COMPONENTS: list[tuple[str, str, str | None, str | None]] = [
    ("in_scope_records", "count", None, None),
    ("reported_current_upb", "sum", "current_upb", "TRUE"),
    ("eligible_active_loans", "count", None, ACTIVE),
    ("eligible_current_upb", "sum", "current_upb", ACTIVE),
    ("excluded_ra_records", "count", None, "delinquency_status_raw='RA'"),
    ("excluded_ra_upb", "sum", "current_upb", "delinquency_status_raw='RA'"),
    ("excluded_xx_records", "count", None, "delinquency_status_raw='XX'"),
    ("excluded_xx_upb", "sum", "current_upb", "delinquency_status_raw='XX'"),
    ("zero_balance_records", "count", None, "zero_balance_code IS NOT NULL"),
    *(m for n in (1, 2, 3) for m in _pair(f"d{30 * n}_plus", f"{ACTIVE} AND delinquency_months>={n}")),
    ("issuance_upb", "sum", "issuance_upb", "TRUE"),
    *(m for k, v in _KNOWN.items() for m in ((f"{k}_weighted_sum", "weighted", f"current_upb * {v}", f"{ACTIVE} AND {v} IS NOT NULL"), (f"{k}_known_upb", "sum", "current_upb", f"{ACTIVE} AND {v} IS NOT NULL"))),
    *_pair("new_modification", f"{ACTIVE} AND modification_flag='Y'"),
    ("modified_upb", "sum", "current_upb", f"{ACTIVE} AND modification_flag IN ('Y','P')"),
    ("payment_deferral_upb", "sum", "current_upb", f"{ACTIVE} AND {_DEFERRED}"),
    ("borrower_assistance_upb", "sum", "current_upb", f"{ACTIVE} AND {_ASSISTED}"),
    ("assistance_exposure_upb", "sum", "current_upb", f"{ACTIVE} AND ({_DEFERRED} OR {_ASSISTED})"),
    ("disaster_upb", "sum", "current_upb", f"{ACTIVE} AND delinquency_due_to_disaster='Y'"),
    ("cumulative_actual_loss", "sum", "actual_loss", "TRUE"),
    ("actual_loss_observations", "present", "actual_loss", None),
]

#: Sums that only serve weighted averages; left out where a row is shown.
INTERNAL = [n for n, *_ in COMPONENTS if n.endswith(("_weighted_sum", "_known_upb"))]

RATIOS: list[tuple[str, str, str]] = [
    ("average_active_loan_upb", "eligible_current_upb", "eligible_active_loans"),
    *((f"d{n}_plus_rate", f"d{n}_plus_upb", "eligible_current_upb") for n in (30, 60, 90)),
    *((f"release_compatible_d{n}_plus_rate", f"d{n}_plus_upb", "reported_current_upb") for n in (30, 60)),
    ("pool_factor", "reported_current_upb", "issuance_upb"),
    ("wa_classic_fico", "fico_weighted_sum", "fico_known_upb"),
    *((f"wa_original_{k}", f"{k}_weighted_sum", f"{k}_known_upb") for k in ("ltv", "cltv", "dti")),
    ("wa_current_coupon", "coupon_weighted_sum", "coupon_known_upb"),
    ("wa_loan_age", "loan_age_weighted_sum", "loan_age_known_upb"),
    ("new_modification_rate_count", "new_modification_loans", "eligible_active_loans"),
    ("new_modification_rate_upb", "new_modification_upb", "eligible_current_upb"),
    ("modified_share", "modified_upb", "eligible_current_upb"),
    *((f"{k}_share", f"{k}_upb", "eligible_current_upb") for k in ("payment_deferral", "borrower_assistance", "assistance_exposure", "disaster")),
]

_MATCHED = "is_matched"
_OWED = f"{_MATCHED} AND prior_upb>0"
_OPEN = f"{_MATCHED} AND prior_zero_balance_code IS NULL"
#: Month from which credit events of actual-loss pools take the wider list of codes.
CREDIT_CUTOVER = "202607"


# Zero-balance codes that are credit events, by a pool's construct and by when it is read against the cutover.
CREDIT_CODES = [
    ("actual_loss", "<", ("03", "09")),
    ("actual_loss", ">=", ("02", "03", "09", "15")),
    ("fixed_severity", None, ("02", "03", "04", "08", "97")),
]


def credit_exit(cutover: str = CREDIT_CUTOVER) -> str:
    """Whether a row's new zero-balance code is a credit event under its pool's construct."""
    rule = lambda construct, side, codes: " AND ".join([f"pool_construct='{construct}'", *([f"reporting_period{side}'{cutover}'"] if side else []), "zero_balance_code IN ({})".format(",".join(f"'{c}'" for c in codes))])
    return "(" + " OR ".join(f"({rule(*r)})" for r in CREDIT_CODES) + ")"


def flow_measures(cutover: str = CREDIT_CUTOVER) -> list[tuple[str, str, str | None, str | None]]:
    def both(name: str, when: str) -> list[tuple]:
        return [(f"{name}_loans", "count", None, when), (f"{name}_upb", "sum", "prior_upb", when)]

    return [
        ("prior_records", "count", None, None),
        ("matched_records", "count", None, _MATCHED),
        ("approved_exit_records", "count", None, f"NOT {_MATCHED} AND prior_zero_balance_code IS NOT NULL"),
        ("revision_exception_records", "count", None, "FALSE"),
        ("error_unmatched_records", "count", None, f"NOT {_MATCHED} AND prior_zero_balance_code IS NULL"),
        ("matched_prior_upb", "sum", "prior_upb", _MATCHED),
        *both("prior_current_matched", f"{_OWED} AND prior_delinquency_months=0"),
        *both("current_to_d30", f"{_OWED} AND prior_delinquency_months=0 AND delinquency_months>=1"),
        *both("prior_d30_matched", f"{_OWED} AND prior_delinquency_months=1"),
        *both("d30_to_d60", f"{_OWED} AND prior_delinquency_months=1 AND delinquency_months>=2"),
        *both("prior_d30_plus_matched", f"{_OWED} AND prior_delinquency_months>=1"),
        *both("cured", f"{_OWED} AND prior_delinquency_months>=1 AND delinquency_months=0"),
        *both("beginning_eligible", f"{_OWED} AND prior_delinquency_months IS NOT NULL"),
        *both("voluntary_payoff", f"{_OPEN} AND zero_balance_code='01'"),
        *both("credit_event_exit", f"{_OPEN} AND {credit_exit(cutover)}"),
        ("new_modification_loans", "count", None, f"{_MATCHED} AND modification_flag='Y'"),
        ("new_payment_deferral_loans", "count", None, f"{_MATCHED} AND payment_deferral_flag='C'"),
        ("actual_loss_increment_observations", "count", None, f"{_MATCHED} AND actual_loss IS NOT NULL AND prior_actual_loss IS NOT NULL"),
    ]


#: Not coalesced: null tells that no loan had a loss observed in both periods.
LOSS_INCREMENT = ("actual_loss_increment", "actual_loss-prior_actual_loss", f"{_MATCHED} AND actual_loss IS NOT NULL AND prior_actual_loss IS NOT NULL")

FLOW_RATES: list[tuple[str, str, str]] = [
    ("loan_match_rate", "matched_records", "prior_records"),
    *((f"{k}_rate_{how}", f"{k}_{what}", f"{base}_{what}") for k, base in (("current_to_d30", "prior_current_matched"), ("d30_to_d60", "prior_d30_matched")) for how, what in (("count", "loans"), ("upb", "upb"))),
    ("cure_rate_count", "cured_loans", "prior_d30_plus_matched_loans"),
    ("cure_rate_upb", "cured_upb", "prior_d30_plus_matched_upb"),
    *((f"{k}_rate_{how}", f"{k}_{what}", f"beginning_eligible_{what}") for k in ("voluntary_payoff", "credit_event_exit") for how, what in (("count", "loans"), ("upb", "upb"))),
    ("actual_loss_rate", "actual_loss_increment", "beginning_eligible_upb"),
]


def aggregate(measure: tuple[str, str, str | None, str | None]) -> Column:
    """The Spark aggregate of a declared measure."""
    name, kind, value, when = measure
    if kind == "count":
        out = F.count("*") if when is None else F.count_if(F.coalesce(F.expr(when), F.lit(False)))
    elif kind == "present":
        out = F.count(F.expr(value))
    else:
        kept = F.expr(value) if when == "TRUE" else F.when(F.expr(when), F.expr(value))
        total = F.sum(kept)
        out = total if name == "reported_current_upb" else F.coalesce(total, F.lit(0))
    return out.cast(KINDS[kind]).alias(name)


#: Amounts are summed as two whole numbers, units of ten million and the cents below one: sums of decimals of
#: twenty digits cost each row many times as much. Cents hold for nine billion rows of a group; units overflow only
#: where the whole sum no longer fits its type.
_UNIT = 10**7


def with_halves(rows: DataFrame, measures: list[tuple]) -> DataFrame:
    """Rows with the halves of every amount that the measures sum, each computed once."""
    names = list(dict.fromkeys(value for _, kind, value, _ in measures if kind == "sum"))
    units = [F.expr(f"cast({n} as bigint) div {_UNIT}").alias(f"{n}_units") for n in names]
    cents = [((F.col(n) % _UNIT) * 100).cast("bigint").alias(f"{n}_cents") for n in names]
    return rows.select("*", *units, *cents)


def in_halves(measure: tuple[str, str, str | None, str | None]) -> Column:
    """:func:`aggregate` over rows of :func:`with_halves`: the same value, exactly."""
    name, kind, value, when = measure
    if kind != "sum":
        return aggregate(measure)
    part = lambda half: F.sum(F.col(f"{value}_{half}") if when == "TRUE" else F.when(F.expr(when), F.col(f"{value}_{half}"))).cast("decimal(24,2)")
    total = part("units") * F.lit(_UNIT) + part("cents") * F.lit("0.01").cast("decimal(2,2)")
    return (total if name == "reported_current_upb" else F.coalesce(total, F.lit(0))).cast(KINDS[kind]).alias(name)
