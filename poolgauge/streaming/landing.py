"""Streaming intake: landed Parquet files of source rows become new partitions and a refreshed store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from poolgauge.functions.layout import FOUNDATION_SCHEMA
from poolgauge.functions.measures import CREDIT_CUTOVER
from poolgauge.operators.typed import typed
from poolgauge.plans.incremental import refresh
from poolgauge.plans.tables import Store
from poolgauge.sources import archive
from poolgauge.storage import joined, names


def intake(spark: SparkSession, landing: str, root: str, store: Store, checkpoint: str, step: str = "month", cutover: str = CREDIT_CUTOVER) -> StreamingQuery:
    """Process all landed files and stop. Revisions of partitions that another batch stored fail the batch.

    A batch owns one folder, named by its number, and overwrites it: wherever
    a run breaks off, the batch that runs again writes the same rows to the
    same place and the refresh finds them new, or committed already.
    """
    source = spark.readStream.schema(FOUNDATION_SCHEMA).parquet(landing)
    data = joined(root, "data")

    def batch(rows: DataFrame, batch_id: int) -> None:
        if rows.isEmpty():
            return
        offered = rows.select("deal_id", F.col("period").alias("reporting_period")).distinct()
        if any(n.startswith("batch=") and n != f"batch={batch_id}" for n in names(data)):
            archive.refuse_overlap(archive.read(spark, data).where(F.col("batch") != batch_id), offered)
        archive.write(rows, joined(data, f"batch={batch_id}"), mode="overwrite")
        stored = archive.read(spark, data).drop("batch")
        refresh(spark, store, typed(stored, step), step, cutover, source=stored)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
