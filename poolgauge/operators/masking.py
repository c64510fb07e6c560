"""Masked publication of loan-period rows and the audit of its tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolgauge.functions.columns import token
from poolgauge.operators.control import GateError, gate

LOAN_DIGITS, GEO_DIGITS = 20, 12
MIN_KEY_BYTES = 32
#: Masked fields: the prefix and the digits of their tokens.
TOKENS = {"loan_identifier": ("loan-", LOAN_DIGITS), "postal_code_3_digit": ("geo-", GEO_DIGITS)}


def key_column(key: str | Column) -> Column:
    """The masking key as a column.

    A string becomes a literal of the plan, and plans are logged: pass a column
    (from a one-row table only the masking job may read) where that matters.
    Keys under 32 bytes are refused.
    """
    if isinstance(key, Column):
        return key
    if len(bytes.fromhex(key)) < MIN_KEY_BYTES:
        raise GateError(f"a masking key has at least {MIN_KEY_BYTES} bytes")
    return F.lit(key)


def masked(foundation: DataFrame, key: str | Column) -> DataFrame:
    """The same columns in the same order; loan and three-digit postal code are keyed tokens."""
    k = key_column(key)
    return foundation.withColumns({c: token(c, k, prefix, digits) for c, (prefix, digits) in TOKENS.items()})


def token_audit(public: DataFrame) -> DataFrame:
    """One row: rows, partitions, and values that are not tokens. A full scan, not a sample."""
    bad = lambda c, shape: F.count_if(F.col(c).isNotNull() & ~F.col(c).rlike(shape))
    return public.agg(
        F.count("*").alias("records"),
        F.count_distinct(F.concat_ws("|", "deal_id", "period")).alias("partitions"),
        bad("loan_identifier", rf"^loan-[0-9a-f]{{{LOAN_DIGITS}}}\z").alias("invalid_loan_tokens"),
        bad("postal_code_3_digit", rf"^geo-[0-9a-f]{{{GEO_DIGITS}}}\z").alias("invalid_geo_tokens"),
    )


def check_masking(foundation: DataFrame, public: DataFrame) -> dict:
    """Same layout, same rows per partition, only tokens."""
    if foundation.columns != public.columns:
        raise GateError("the masked layout differs")
    count = lambda d, n: d.groupBy("deal_id", "period").agg(F.count("*").alias(n)).alias(n)
    same = F.col("a.deal_id").eqNullSafe(F.col("b.deal_id")) & F.col("a.period").eqNullSafe(F.col("b.period"))
    if not count(foundation, "a").join(count(public, "b"), same, "full_outer").where(~F.col("a.a").eqNullSafe(F.col("b.b"))).isEmpty():
        raise GateError("masked partitions have other row counts")
    return gate("tokens", token_audit(public), lambda r: not (r["invalid_loan_tokens"] or r["invalid_geo_tokens"]))
