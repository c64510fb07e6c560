"""The aggregate projection: one JSON document of small tables, and the check of what may be in it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolgauge.operators.control import GateError
from poolgauge.plans.tables import Tables
from poolgauge.storage import exists, move, remove

# The columns of the published sections, in order.
PORTFOLIO = (
    "reporting_period", "eligible_active_loans", "eligible_current_upb", "excluded_ra_records", "excluded_ra_upb", "excluded_xx_records",
    "excluded_xx_upb", "d30_plus_upb", "d60_plus_upb", "d90_plus_upb", "d30_plus_rate", "d60_plus_rate", "d90_plus_rate", "d60_change_1m_bps",
    "d60_change_3m_bps", "metric_version",
)
DEAL = (
    "deal_id", "reporting_period", "eligible_active_loans", "eligible_current_upb", "d60_plus_upb", "d30_plus_rate", "d60_plus_rate", "d90_plus_rate",
    "d60_change_1m_bps", "d60_change_3m_bps", "metric_version",
)
FLOW = (
    "loan_match_rate", "current_to_d30_rate_upb", "d30_to_d60_rate_upb", "cure_rate_upb", "voluntary_payoff_rate_upb",
)
EFFECTS = ("rate_effect_bps", "mix_effect_bps", "total_contribution_bps")
POOL = (
    "deal_id", "reference_pool_number", "reporting_period", "eligible_active_loans", "eligible_current_upb", "d60_plus_upb", "d60_plus_rate",
    "d60_change_1m_bps", "metric_version",
)
CATALOG = (
    "metric_id", "metric_version", "definition", "method", "desired_direction", "baseline", "supported_decision", "limitation",
)

#: Names that no published document may hold, at any depth.
FORBIDDEN = ("loan_identifier", "postal_code_3_digit", "payment_history", "seller_name", "servicer_name", "property_state", "classic_fico_value", "original_ltv_value", "original_dti_value")
#: Texts that tell of places and rows that are not published: folders of the store and shown identifiers.
FORBIDDEN_TEXT = ("deal_id=", "/foundation", "pool_components", "restricted-", "file:/", "s3a://", "hdfs://")


def _frames(t: Tables) -> dict[str, tuple[DataFrame, list[str]]]:
    keys = ["deal_id", "reporting_period"]
    deals = t.deal.select(*DEAL).join(t.flow.select(*keys, *FLOW), keys, "left").join(t.decomposition.select(*keys, *EFFECTS), keys, "left")
    return {
        "portfolio_periods": (t.portfolio.select(*PORTFOLIO), ["reporting_period"]),
        "deal_periods": (deals, ["reporting_period", "deal_id"]),
        "pool_periods": (t.pool.select(*POOL), ["reporting_period", "deal_id", "reference_pool_number"]),
        "metric_catalog": (t.catalog.select(*CATALOG), ["metric_id"]),
    }


#: Columns of the sections that are counts and amounts, and those written as strings to keep their cents.
COUNTS = {
    "portfolio_periods": ["reporting_period", "eligible_active_loans", "eligible_current_upb", "excluded_ra_records", "excluded_ra_upb", "d30_plus_upb", "d60_plus_upb", "d90_plus_upb", "metric_version"],
    "pool_periods": ["deal_id", "reference_pool_number", "reporting_period", "eligible_active_loans", "eligible_current_upb", "d60_plus_upb", "metric_version"],
}
AMOUNTS = ("eligible_current_upb", "excluded_ra_upb", "d30_plus_upb", "d60_plus_upb", "d90_plus_upb")


def sections(t: Tables, only: dict[str, list[str]] | None = None) -> DataFrame:
    """(section, position, body): every row of every section as JSON, decimals as strings, in export order.

    ``only``: the sections and columns to take, all if left out.
    """
    out = None
    for name, (df, order) in _frames(t).items():
        if only is not None:
            if name not in only:
                continue
            df = df.select(*only[name])
        plain = [F.col(c).cast("string").alias(c) if k.startswith("decimal") else F.col(c) for c, k in df.dtypes]
        body = df.select(F.lit(name).alias("section"), F.concat_ws("|", *order).alias("position"), F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("body"))
        out = body if out is None else out.unionByName(body)
    return out


def forbidden_names(kind: T.DataType, path: str = "$") -> list[str]:
    """Paths of a type's forbidden names, whatever structs, arrays and maps they lie in; no row is read."""
    if isinstance(kind, T.StructType):
        own = [f"{path}.{f.name}" for f in kind.fields if f.name in FORBIDDEN]
        return own + [p for f in kind.fields for p in forbidden_names(f.dataType, f"{path}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        return forbidden_names(kind.elementType, f"{path}[]")
    if isinstance(kind, T.MapType):
        return forbidden_names(kind.keyType, f"{path}{{key}}") + forbidden_names(kind.valueType, f"{path}{{}}")
    return []


def breach(body: Column) -> Column:
    """The first forbidden text or name that a row's JSON holds at any depth, null if none.

    Names are looked for too, as keys of maps are data. Quotes within a text
    are escaped in JSON, so a text that speaks of a name is none.
    """
    names = [F.when(F.contains(body, F.lit(f'"{n}":')), F.lit(n)) for n in FORBIDDEN]
    texts = [F.when(F.contains(body, F.lit(x)), F.lit(x)) for x in FORBIDDEN_TEXT]
    return F.coalesce(*names, *texts)


def breaches(bodies: DataFrame) -> DataFrame:
    """section, its rows, and how many of them hold what may not be published, with the first such text."""
    found = bodies.select("section", breach(F.col("body")).alias("breach"))
    return found.groupBy("section").agg(F.count("*").alias("records"), F.count("breach").alias("forbidden_records"), F.min("breach").alias("first_breach"))


def publish(spark: SparkSession, t: Tables, folder: str) -> DataFrame:
    """Write every section as JSON, a line per row, if nothing in it is forbidden; returns :func:`breaches` of what was written.

    Names are checked in the types before anything is read, texts on the
    executors while rows are written, beside the folder, which gets its name
    when the lines read back are as many as were written. Nothing is collected.
    """
    frames = {n: df for n, (df, _) in _frames(t).items()}
    if wrong := [p for n, df in frames.items() for p in forbidden_names(df.schema, n)]:
        raise GateError(f"{wrong[0]} may not be published")
    if exists(folder):
        raise GateError(f"{folder} already holds a publication")
    staged, seen = f"{folder}.staged-{uuid.uuid4().hex}", Observation()
    found = breach(F.col("body"))
    # dealt by range before they are observed, as finding the ranges runs over the rows as well
    rows = sections(t).repartitionByRange("section", "position").sortWithinPartitions("section", "position")
    rows = rows.observe(seen, F.count("*").alias("records"), F.count(found).alias("forbidden"), F.min(found).alias("first"))
    rows.write.partitionBy("section").json(staged)
    facts, written = seen.get, read(spark, staged).count()
    if facts["forbidden"]:
        remove(staged)
        raise GateError(f"{facts['forbidden']} rows hold what may not be published, such as {facts['first']}")
    # tasks that ran again after a lost executor are observed again: count the source itself
    if written != facts["records"] and written != (offered := sections(t).count()):
        remove(staged)
        raise GateError(f"{offered} rows were to be published, {written} were")
    move(staged, folder)
    return breaches(read(spark, folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(position, body, section) of a publication."""
    return spark.read.schema("position string, body string, section string").json(folder)


def document(t: Tables) -> dict:
    """The whole document as one value, for callers that want one; :func:`publish` is the way of any size. Its sections have a row per deal or pool and period."""
    rows = sections(t).orderBy("section", "position").collect()
    doc: dict = {name: [] for name in _frames(t)}
    for r in rows:
        doc[r["section"]].append(json.loads(r["body"]))
    doc["controls"] = {name: len(doc[name]) for name in list(doc)}
    check_boundary(doc)
    return doc


def check_boundary(value, path: str = "$") -> None:
    """Walk a document and refuse forbidden names and texts."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k in FORBIDDEN:
                raise GateError(f"{path}.{k} may not be published")
            check_boundary(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            check_boundary(v, f"{path}[{i}]")
    elif isinstance(value, str) and (found := [t for t in FORBIDDEN_TEXT if t in value]):
        raise GateError(f"{path} may not hold {found[0]}")
