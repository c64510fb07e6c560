"""Small column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dec(name: str, precision: int = 20, scale: int = 2) -> Column:
    """A fail-safe decimal of a source string."""
    return F.col(name).try_cast(f"decimal({precision},{scale})")


def whole(name: str) -> Column:
    """A fail-safe integer; fractions and exponents are rounded half up rather than refused.

    Texts that are an integer as it is written need no decimals, which are slow.
    """
    plain = F.col(name).try_cast("int")
    return F.when(plain.cast("string") == F.col(name), plain).otherwise(F.round(F.col(name).try_cast("decimal(38,10)"), 0).try_cast("int"))


def digits(value: Column, n: int) -> Column:
    """The number that a text of just ``n`` digits stands for, else null; without a pattern, as it is asked of every row."""
    number = value.try_cast("int")
    return F.when((number >= 0) & (F.lpad(number.cast("string"), n, "0") == value), number)


def between_or_null(value: Column, low: float, high: float) -> Column:
    return F.when(value.between(low, high), value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; null where the denominator is zero or null."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def month_start(period: Column) -> Column:
    """First day of a ``YYYYMM`` period; null unless it is six digits of a real month."""
    number = digits(period, 6)
    return F.when((number % 100).between(1, 12), F.make_date((number / 100).cast("int"), number % 100, F.lit(1)))


def shifted(date: Column, steps: int, step: str) -> Column:
    """A date moved by whole months or days."""
    return F.add_months(date, steps) if step == "month" else F.date_add(date, steps)


def period_of(date: Column, step: str) -> Column:
    return F.date_format(date, "yyyyMM" if step == "month" else "yyyyMMdd")


def display_id(name: str) -> Column:
    """A row's identifier for display: its last four characters."""
    return F.concat(F.lit("restricted-"), F.right(F.col(name), F.lit(4)))


def token(name: str, key: Column, prefix: str, digits: int) -> Column:
    """A keyed token of an identifier; null and empty identifiers have none."""
    value = F.col(name)
    hashed = F.left(F.sha2(F.concat_ws(":", key, value), 256), F.lit(digits))
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(prefix), hashed))


# Meanings of the codes, as the disclosure layout lists them.
LABELS = {
    "loan_purpose": {"P": "Purchase", "C": "Cash-out refinance", "N": "No cash-out refinance", "R": "Refinance, not specified", "9": "Unavailable"},
    "occupancy_status": {"P": "Primary residence", "S": "Second home", "I": "Investment property", "O": "Owner occupied", "9": "Unavailable"},
    "modification_flag": {"Y": "Modified this period", "P": "Modified earlier", "N": "Not modified"},
    "borrower_assistance_plan": {"F": "Forbearance", "R": "Repayment plan", "T": "Trial period", "N": "None"},
    "payment_deferral_flag": {"C": "Deferred this period", "P": "Deferred earlier", "N": "None"},
    "zero_balance_code": {"01": "Prepaid or matured", "02": "Third-party sale", "03": "Short sale or charge-off", "09": "REO disposition", "15": "Note sale", "96": "Defect", "97": "Credit event"},
}


def label(name: str, missing: str = "Not reported") -> Column:
    """The meaning of a code; an unknown code stands for itself."""
    known = F.create_map(*[F.lit(x) for pair in LABELS[name].items() for x in pair])
    value = F.col(name)
    return F.when(value.isNull() | (value == ""), F.lit(missing)).otherwise(F.coalesce(F.try_element_at(known, value), value))


# What a delinquency status of an exact code is called.
STATUS_LABELS = {"00": "Current", "01": "D30", "02": "D60", "RA": "REO"}


def record_status(status: Column, exit_code: Column) -> Column:
    """The status of a record in words: by its code, D90+ from three months on, else the raw status, else how it left."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair]), status)
    late = F.when(status.rlike(r"^[0-9]{2}\z") & (status.try_cast("int") >= 3), F.lit("D90+"))
    left = F.when(exit_code != "", F.concat(F.lit("Zero balance "), exit_code))
    return F.coalesce(named, late, F.nullif(status, F.lit("")), left, F.lit("Unavailable"))
