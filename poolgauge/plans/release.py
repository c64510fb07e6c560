"""The release: its aggregate as CSV, masked rows per partition, and the checks of what was published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolgauge.operators import control, masking
from poolgauge.operators.control import GateError
from poolgauge.sources import archive, intake
from poolgauge.sources.foundation import Foundation
from poolgauge.storage import exists, joined, names

#: Columns of the release file in order, with the types that a reader gives them.
RELEASE = {"reporting_period": "string", "deal_id": "string", "reference_pool_number": "string", "current_upb": "double", "d30_plus_upb": "double", "d60_plus_upb": "double", "d30_plus_rate": "double", "d60_plus_rate": "double", "records_aggregated": "long", "ra_records": "long", "xx_records": "long", "source_classification": "string"}
#: What a release may be made of.
CLASSIFICATIONS = ("public-disclosure", "synthetic-fixture")


def write_csv(aggregate: DataFrame, folder: str, classification: str) -> None:
    """The aggregate as one sorted CSV with a header; it has a row per pool and period, so one file is right."""
    if classification not in CLASSIFICATIONS:
        raise GateError(f"{classification} may not be released")
    rows = aggregate.withColumn("source_classification", F.lit(classification)).select(*RELEASE)
    rows.coalesce(1).sortWithinPartitions("reporting_period", "deal_id", "reference_pool_number").write.mode("overwrite").option("header", True).csv(folder)


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A release by its fixed types; a file with other columns, or a value of another type, fails."""
    head = spark.read.option("header", True).csv(folder).columns
    if head != list(RELEASE):
        raise GateError(f"a release has the columns {list(RELEASE)}")
    rows = spark.read.option("header", True).option("mode", "FAILFAST").schema(", ".join(f"{n} {t}" for n, t in RELEASE.items())).csv(folder)
    if not rows.where(~F.col("source_classification").isin(*CLASSIFICATIONS) | F.col("source_classification").isNull()).isEmpty():
        raise GateError("a release holds rows of no released classification")
    return rows


def rule_breaks(release: DataFrame) -> DataFrame:
    """One row of counts that have to be zero: delinquent balances above wider ones, and rates that are not their balances' ratio."""
    u, d30, d60 = (F.col(c) for c in ("current_upb", "d30_plus_upb", "d60_plus_upb"))
    off = lambda r, d: F.abs(F.col(r) - F.coalesce(d / F.nullif(u, F.lit(0.0)), F.lit(0.0))) > 1e-9
    return release.agg(F.count("*").alias("groups"), F.count_if((d60 > d30) | (d30 > u)).alias("unordered_balances"), F.count_if(off("d30_plus_rate", d30) | off("d60_plus_rate", d60)).alias("wrong_rates"))


def rebuilt_if_behind(spark: SparkSession, folder: str, foundation: DataFrame, classification: str) -> DataFrame:
    """The release of ``folder``, made anew if a deal's period is new, gone, or has another number of records in the foundation."""
    if exists(folder):
        keys = ["deal_id", "reporting_period"]
        have = read_csv(spark, folder).groupBy(*keys).agg(F.sum("records_aggregated").alias("had"))
        now = foundation.groupBy("deal_id", F.col("period").alias("reporting_period")).agg(F.count("*").alias("records"))
        if now.join(have, keys, "full_outer").where(~F.col("had").eqNullSafe(F.col("records"))).isEmpty():
            return read_csv(spark, folder)
    write_csv(control.release_aggregate(foundation), folder, classification)
    return read_csv(spark, folder)


def best_totals(official: DataFrame | None, intake: DataFrame) -> DataFrame:
    """deal_id, reporting_period, records, origin: the official total where there is one, else what intake counted."""
    counted = intake.select("deal_id", "reporting_period", "records", F.lit("intake").alias("origin"))
    if official is None:
        return counted
    given = official.select("deal_id", "reporting_period", F.col("records").alias("o"))
    met = counted.join(given, ["deal_id", "reporting_period"], "left")
    return met.select("deal_id", "reporting_period", F.coalesce("o", "records").alias("records"), F.when(F.col("o").isNull(), "intake").otherwise("official").alias("origin"))


def publish_masked(spark: SparkSession, foundation: DataFrame, root: str, key: str | Column) -> DataFrame:
    """Masked rows by deal and period, one sorted file each; read back, audited and counted against what went in.

    Returns deal_id, reporting_period, records of the published partitions.
    """
    if names(root):
        raise GateError(f"{root} already holds a publication")
    public = masking.masked(foundation, key)
    archive.write(public, joined(root, "data"))
    back = archive.read(spark, joined(root, "data"))
    masking.check_masking(foundation, back.select(*foundation.columns))  # counts of every partition, and all tokens
    return archive.stored_counts(back)


def publish_stored(spark: SparkSession, made: Foundation, root: str, key: str, most: int = intake.MASKED_ROWS) -> DataFrame:
    """:func:`publish_masked` of a stored foundation, whose partitions tasks mask one by one without a shuffle; those of more than ``most`` rows are left to Spark's writer."""
    if names(root):
        raise GateError(f"{root} already holds a publication")
    masking.key_column(key)
    data, folders = joined(root, "data"), made.folders()
    done = intake.masked(spark, [(joined(made.root, path), joined(data, path)) for _, _, path in folders], key, most).collect()  # a row per partition
    if large := [folders[r["part"]][:2] for r in done if r["records"] is None]:
        archive.write(masking.masked(made.read(large).drop("reporting_period"), key), data, mode="append")
    rows, back = made.read().drop("reporting_period"), archive.read(spark, data)
    masking.check_masking(rows, back.select(*rows.columns))  # counts of every partition, and all tokens
    return archive.stored_counts(back)


def parity(published: DataFrame, regenerated: DataFrame) -> DataFrame:
    """section, published and regenerated rows, and rows that differ: the last has to be zero (see :func:`projection.sections`)."""
    side = lambda d, n: d.groupBy("section", "position", "body").agg(F.count("*").alias(n))
    met = side(published, "a").join(side(regenerated, "b"), ["section", "position", "body"], "full_outer").fillna(0, ["a", "b"])
    return met.groupBy("section").agg(F.sum("a").alias("published"), F.sum("b").alias("regenerated"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("differing"))


def orphans(planned: DataFrame, committed: DataFrame) -> DataFrame:
    """Planned (deal_id, reporting_period) that were not committed, and committed ones that nobody planned."""
    keys = ["deal_id", "reporting_period"]
    a, b = planned.select(*keys).distinct(), committed.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("orphan", F.lit("planned")).unionByName(b.join(a, keys, "left_anti").withColumn("orphan", F.lit("committed")))
