"""The synthetic tranche aggregate: its rates and its gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolgauge.operators.control import GateError, gate

SCHEMA = "reporting_period string, deal_id string, program string, reference_pool_upb double, delinquent_upb double, prepayment_upb double, credit_event_upb double, tranche string, attachment_pct double, detachment_pct double, tranche_notional double, source_classification string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
PROHIBITED = ("borrower", "household", "property", "address", "loan_id", "fico")
CLASSIFICATION = "synthetic-fixture"

# The columns of COLUMNS but the last, row by row.
_ROWS = """
2025-01 DEMO-2024-A STACR 100000000 1200000 800000 150000 M-1 0.0325 0.0425 1000000
2025-01 DEMO-2024-A STACR 100000000 1200000 800000 150000 M-2 0.0225 0.0325 1000000
2025-01 DEMO-2024-A STACR 100000000 1200000 800000 150000 B-1 0.0150 0.0225 750000
2025-02 DEMO-2024-A STACR 98700000 1100000 1200000 170000 M-1 0.0325 0.0425 987000
2025-02 DEMO-2024-A STACR 98700000 1100000 1200000 170000 M-2 0.0225 0.0325 987000
2025-02 DEMO-2024-A STACR 98700000 1100000 1200000 170000 B-1 0.0150 0.0225 740250
2025-01 DEMO-2024-B ACIS 80000000 700000 600000 80000 M-1 0.0300 0.0400 800000
2025-01 DEMO-2024-B ACIS 80000000 700000 600000 80000 B-1 0.0125 0.0300 1400000
2025-02 DEMO-2024-B ACIS 79200000 750000 900000 90000 M-1 0.0300 0.0400 792000
2025-02 DEMO-2024-B ACIS 79200000 750000 900000 90000 B-1 0.0125 0.0300 1386000
"""
ROWS = [(*r[:3], *map(float, r[3:7]), r[7], *map(float, r[8:]), CLASSIFICATION) for r in map(str.split, _ROWS.strip().splitlines())]

_PARTS = ("delinquent_upb", "prepayment_upb", "credit_event_upb")
_POOL = ("reference_pool_upb", *_PARTS)
_NUMBERS = (*_POOL, "attachment_pct", "detachment_pct", "tranche_notional")


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of exactly the approved columns."""
    head = spark.read.option("header", True).csv(path).columns
    if set(head) != set(COLUMNS) or any(t in c.lower() for c in head for t in PROHIBITED):
        raise GateError(f"columns differ from the approved ones: {sorted(head)}")
    types = dict(x.split() for x in SCHEMA.split(", "))
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(", ".join(f"{c} {types[c]}" for c in head)).csv(path).select(*COLUMNS)


def rates(rows: DataFrame) -> DataFrame:
    """Delinquency, prepayment and credit-event rate per pool and period; a pool's tranches repeat its balances."""
    pools = rows.select("reporting_period", "deal_id", *_POOL).distinct()
    part = lambda c: F.round(F.try_divide(F.col(c), F.col("reference_pool_upb")), 8)
    return pools.select("reporting_period", "deal_id", part("delinquent_upb").alias("delinquency_rate"), part("prepayment_upb").alias("prepayment_rate"), part("credit_event_upb").alias("credit_event_rate"))


def gate_counts(rows: DataFrame) -> DataFrame:
    """One row: rows, total notional, and rows or pools that break a rule."""
    number = [F.col(c) for c in _NUMBERS]
    negative, above = number[0] < 0, F.col(_PARTS[0]) > F.col("reference_pool_upb")
    for c in number[1:]:
        negative = negative | (c < 0)
    for c in _PARTS[1:]:
        above = above | (F.col(c) > F.col("reference_pool_upb"))
    period = F.col("reporting_period")
    valid = period.rlike(r"^\d{4}-\d{2}\z") & F.try_to_timestamp(F.concat(period, F.lit("-01")), F.lit("yyyy-MM-dd")).isNotNull()
    checked = rows.agg(
        F.count("*").alias("records"),
        F.sum(F.col("tranche_notional").cast("decimal(24,2)")).cast("double").alias("tranche_notional_total"),
        F.count_if(F.col("source_classification") != CLASSIFICATION).alias("unlabelled"),
        F.count_if(~valid).alias("invalid_period"),
        F.count_if(negative).alias("negative"),
        F.count_if(above).alias("part_above_pool"),
        F.count_if(F.col("attachment_pct") >= F.col("detachment_pct")).alias("invalid_tranche"),
    )
    conflicts = rows.groupBy("reporting_period", "deal_id").agg(F.count_distinct(F.struct(*_POOL)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("pool_conflicts"))
    return checked.join(conflicts, F.lit(True))  # one row each


def check(rows: DataFrame, total: float) -> dict:
    clean = ("unlabelled", "invalid_period", "negative", "part_above_pool", "invalid_tranche", "pool_conflicts")
    return gate("baseline", gate_counts(rows), lambda r: r["records"] > 0 and r["tranche_notional_total"] == total and not any(r[c] for c in clean))


def _values() -> str:
    rows = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in r) + ")" for r in ROWS)
    return f"fixture AS (SELECT * FROM (VALUES {rows}) AS t({', '.join(COLUMNS)}))"


RATES_SQL = f"WITH {_values()} SELECT DISTINCT reporting_period, deal_id, round(delinquent_upb / reference_pool_upb, 8) AS delinquency_rate, round(prepayment_upb / reference_pool_upb, 8) AS prepayment_rate, round(credit_event_upb / reference_pool_upb, 8) AS credit_event_rate FROM fixture"
GATES_SQL = f"""WITH {_values()} SELECT count(*) AS records, sum(tranche_notional) AS tranche_notional_total, count(*) FILTER (WHERE source_classification <> 'synthetic-fixture') AS unlabelled,
  count(*) FILTER (WHERE try_cast(reporting_period || '-01' AS DATE) IS NULL) AS invalid_period, count(*) FILTER (WHERE least(reference_pool_upb, delinquent_upb, prepayment_upb, credit_event_upb, attachment_pct, detachment_pct, tranche_notional) < 0) AS negative,
  count(*) FILTER (WHERE greatest(delinquent_upb, prepayment_upb, credit_event_upb) > reference_pool_upb) AS part_above_pool, count(*) FILTER (WHERE attachment_pct >= detachment_pct) AS invalid_tranche,
  (SELECT count(*) FROM (SELECT reporting_period, deal_id FROM fixture GROUP BY ALL HAVING count(DISTINCT (reference_pool_upb, delinquent_upb, prepayment_upb, credit_event_upb)) > 1)) AS pool_conflicts FROM fixture"""
