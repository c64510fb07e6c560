"""Lenses: loan-period panels in source form over order and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolgauge.functions.layout import FIELD_NAMES, LINEAGE


def _as_foundation(rows: DataFrame) -> DataFrame:
    """All source fields; those that the lens does not fill are null strings."""
    have = set(rows.columns)
    fields = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in FIELD_NAMES]
    return rows.select(*LINEAGE, *fields)


def pick(value: Column, *pairs: tuple[int, str]) -> Column:
    """The text paired with a number, else null."""
    out = F
    for number, text in pairs:
        out = out.when(value == number, text)
    return out


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all tasks by a key: an order becomes eight wide rows, so a file's few splits would leave most cores without work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Months at which an order is observed, and the least tasks that deals' years are dealt to: whole years of ten deals.
AGES, YEAR_TASKS = 8, 120


def dealt_by_year(orders: DataFrame) -> DataFrame:
    """Orders dealt by their deal and the years that their months fall into (``y``): one or two rows each, and a deal's year in one task."""
    tasks = max(YEAR_TASKS, int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 10 * 10)
    date = F.col("o_orderdate").cast("date")
    first = F.year(date) * 12 + F.month(date) - 1
    years = F.array_distinct(F.transform(F.array(first, first + AGES - 1), lambda m: F.floor(m / 12).cast("int")))
    rows = orders.select("*", F.explode(years).alias("y"))
    return rows.repartitionById(tasks, F.pmod(F.coalesce(F.col("o_custkey") % 10 + 10 * F.col("y"), F.lit(0)), F.lit(tasks)).cast("int"))


def monthly(orders: DataFrame, by_year: bool = False) -> DataFrame:
    """Every order observed at ages of 0 to 7 months: states, exits, losses and flags follow from its keys.

    ``by_year``: each task has all rows of its deals' years, by deal, month and
    loan, as archives hold them. Orders are shuffled for that, not their rows.
    """
    chosen = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    years = [F.col("y")] if by_year else []
    keyed = (dealt_by_year(chosen) if by_year else dealt(chosen, "o_orderkey")).select(*years, F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck"), F.col("o_totalprice").cast("decimal(20,2)").alias("p"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("orig"))
    ok, ck, k, p = F.col("ok"), F.col("ck"), F.col("k"), F.col("p")
    deal = F.concat(F.lit("D"), (ck % 10).cast("string"))
    # what does not follow from the age is computed once per order, not once per row
    orders_once = keyed.select(
        *years,
        "ok",
        "ck",
        "p",
        "orig",
        (F.year("orig") * 12 + F.month("orig") - 1).alias("months"),
        deal.alias("deal_id"),
        F.concat(deal, F.lit("-P"), (ck % 3).cast("string")).alias("reference_pool_number"),
        ok.cast("string").alias("loan_identifier"),
        p.cast("string").alias("upb_at_issuance"),
        pick(ok % 4, (0, "01"), (1, "02"), (2, "03"), (3, "09")).alias("left_by"),
        F.when(ck % 10 == 9, "9").otherwise("N").alias("distressed_principal_balance_flag"),
        F.when(ok % 50 == 0, "9999").otherwise((600 + ok % 200).cast("string")).alias("classic_fico"),
        F.when(ok % 61 == 0, "999").otherwise((60 + ok % 38).cast("string")).alias("original_ltv"),
        F.when(ok % 43 == 0, "999").otherwise((20 + ok % 40).cast("string")).alias("original_dti"),
        ((300 + ok % 400).cast("decimal(10,2)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(10,5)").cast("string").alias("current_interest_rate"),
        F.date_format("orig", "yyyyMM").alias("first_payment_date"),
        pick(ck % 7, (0, "S"), (1, "I")).otherwise("P").alias("occupancy_status"),
        pick(ok % 3, (0, "P"), (1, "C")).otherwise("N").alias("loan_purpose"),
        F.lpad((ok % 1000).cast("string"), 3, "0").alias("postal_code_3_digit"),
        F.concat(F.lit("S"), (ck % 5).cast("string")).alias("servicer_name"),
    )
    h, zk = (7 * ok + 3 * k * k + ck) % 100, 4 + ok % 8
    # a projection of their own, so that each is computed once however often it is looked at
    aged = orders_once.select("*", F.explode(F.sequence(F.lit(0), F.lit(AGES - 1))).alias("k")).select("*", (k >= zk).alias("gone"), h.alias("h"), (F.col("months") + k).alias("month"))
    if by_year:
        aged = aged.where(F.floor(F.col("month") / 12).cast("int").eqNullSafe(F.col("y"))).sortWithinPartitions("deal_id", "month", "loan_identifier")
    gone, h = F.col("gone"), F.col("h")
    upb = F.when(gone, "0.00").otherwise((p * (100 - k) * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)").cast("string"))
    # whole months give the text that a date gives, which only odd years need
    period = F.when(F.col("month").between(12000, 119999), F.expr("(month div 12) * 100 + month % 12 + 1").cast("string")).otherwise(F.date_format(F.add_months("orig", k), "yyyyMM"))
    rows = aged.select(
        "deal_id",
        F.lit("orders").alias("source_member"),
        F.lit(93).cast("smallint").alias("source_field_count"),
        period.alias("period"),
        "reference_pool_number",
        "loan_identifier",
        upb.alias("current_actual_upb"),
        "upb_at_issuance",
        F.when(gone, F.col("upb_at_issuance")).alias("upb_at_removal"),
        F.when(h < 80, "00").when(h < 88, "01").when(h < 93, "02").when(h < 97, "03").when(h < 99, "RA").otherwise("XX").alias("current_loan_delinquency_status"),
        F.when(gone, F.col("left_by")).alias("zero_balance_code"),
        pick((ok + k) % 37, (0, "Y"), (1, "P")).alias("modification_flag"),
        pick((ok + 2 * k) % 41, (0, "C"), (1, "P")).alias("payment_deferral_flag"),
        pick((ok + 3 * k) % 53, (0, "F"), (1, "R"), (2, "T")).alias("borrower_assistance_plan"),
        F.when((ok + k) % 67 == 0, "Y").alias("delinquency_due_to_disaster"),
        "distressed_principal_balance_flag",
        F.when(gone, (ok % 500 + 5 * k).cast("string")).alias("actual_loss"),
        "classic_fico",
        "original_ltv",
        F.col("original_ltv").alias("original_cltv"),
        "original_dti",
        "current_interest_rate",
        (k + 12).cast("string").alias("loan_age"),
        "first_payment_date",
        "occupancy_status",
        "loan_purpose",
        "postal_code_3_digit",
        "servicer_name",
    )
    return _as_foundation(rows)


def daily(events: DataFrame) -> DataFrame:
    """Users by day: value as balance, the greatest event type as status. Gaps make unmatched and new rows."""
    deal = F.concat(F.lit("D"), (F.col("user_id") % 10).cast("string"))
    code = F.when(F.col("event_type") == "view", "00").when(F.col("event_type") == "click", "01").when(F.col("event_type") == "purchase", "02").when(F.col("event_type") == "error", "03").otherwise("RA")
    rows = events.select(deal.alias("deal_id"), F.concat(deal, F.lit("-P"), (F.col("user_id") % 3).cast("string")).alias("reference_pool_number"), F.col("user_id").cast("string").alias("loan_identifier"), F.date_format(F.col("ts").cast("date"), "yyyyMMdd").alias("period"), F.col("value").cast("decimal(20,2)").alias("v"), code.alias("c"))
    days = rows.groupBy("deal_id", "reference_pool_number", "loan_identifier", "period").agg(F.sum("v").cast("decimal(20,2)").cast("string").alias("current_actual_upb"), F.max("c").alias("current_loan_delinquency_status"))
    return _as_foundation(days.select("*", F.lit("events").alias("source_member"), F.lit(93).cast("smallint").alias("source_field_count"), F.lit("N").alias("distressed_principal_balance_flag")))
