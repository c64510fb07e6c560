"""Helpers that several training-data operators share.

Nothing here collects rows of a corpus to the driver; every helper builds
columns or names a folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the text contracts: space and U+0009..U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or ``setCheckpointDir``; a local default only in local mode.

    Lineage cuts and intermediate files go here because driver and executors
    all see it.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{ensure_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder: survives lost executors, read many times."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is evaluated once per row.

    A lambda that mentions an outer expression would evaluate it for every
    element; binding it as a lambda variable keeps nested higher-order
    functions linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay. Pure ASCII takes ``lower``'s byte-wise way."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def text_key(text: Column) -> Column:
    """With doc_id, what tells rows apart that repeat a doc_id: rows equal in both are alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def packed(df: DataFrame, **named: Column) -> DataFrame:
    """All input columns in one struct ``row`` beside ``named`` ones: no name can clash."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in named.items()])
