"""The metric tables of a foundation, lazily or written as one version."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, fields

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolgauge import storage
from poolgauge.functions.catalog import catalog
from poolgauge.functions.measures import CREDIT_CUTOVER
from poolgauge.operators import attribution, components, control, flow
from poolgauge.operators.typed import typed
from poolgauge.storage import cut, side_by_side


@dataclass
class Tables:
    """All tables of one metric version; :func:`build` makes them lazily."""

    pool_components: DataFrame
    deal_components: DataFrame
    portfolio_components: DataFrame
    pool: DataFrame
    deal: DataFrame
    portfolio: DataFrame
    flow: DataFrame
    layers: DataFrame
    decomposition: DataFrame
    catalog: DataFrame


#: Tables with a row per portfolio period have no deal to be partitioned by.
NAMES = [f.name for f in fields(Tables)]


def seen_in(deal_c: DataFrame) -> DataFrame:
    """What :func:`flow.observed` gives, from deal components instead of the panel."""
    return deal_c.select("deal_id", "period_date", F.col("in_scope_records").alias("records"))


def build(rows: DataFrame, step: str = "month", cutover: str = CREDIT_CUTOVER) -> Tables:
    """Tables over typed rows: the panel is read for components, for flow and for layers; all else comes from checkpointed components."""
    pool_c = cut(components.pool_components(rows))
    deal_c = cut(components.rolled_up(pool_c, components.DEAL))
    portfolio_c = components.rolled_up(deal_c, components.PORTFOLIO)
    deal, portfolio = (cut(components.metrics(c, keys)) for c, keys in ((deal_c, components.DEAL), (portfolio_c, components.PORTFOLIO)))
    pool, effects = components.metrics(pool_c, components.POOL), attribution.decomposition(deal, portfolio)
    moved = flow.measured(flow.totals(rows, step, cutover, seen_in(deal_c)))
    return Tables(pool_c, deal_c, portfolio_c, pool, deal, portfolio, moved, components.risk_layers(rows), effects, catalog(rows.sparkSession))


def inventory(rows: DataFrame) -> DataFrame:
    """What a foundation holds of each deal and period: records, balance and an order-free hash of all typed columns."""
    return rows.groupBy("deal_id", "reporting_period").agg(*_held(rows))


def _held(rows: DataFrame) -> list[Column]:
    content = F.bit_xor(F.xxhash64(*sorted(rows.columns)))
    return [F.count("*").alias("records"), F.sum("current_upb").cast("decimal(24,2)").alias("upb"), content.alias("content")]


#: Counters of a survey, besides its records, that the gate of inputs reads.
GATES = ("invalid_upb", "invalid_status", "unknown_construct")


def survey(rows: DataFrame) -> DataFrame:
    """Inventory, risk layers and the counters of the gate of inputs by deal and period, in one read of the panel."""
    return rows.groupBy(*components.DEAL, *components.PERIOD).agg(*_held(rows), *control.input_gates(), *components.layer_sums())


#: Tables that hold a row per period at most, or none: each version writes them whole.
WHOLE = ("portfolio_components", "portfolio", "catalog", "inventory")


class Store:
    """Versions of the metric tables below a root; a pointer file names the current one.

    A table's rows lie in one folder per period. A version is a list: for each
    table, which periods are read from the folders of which version. So a
    version that changes one period writes that period, and refers to all
    others where they are. It is written beside the others and becomes current
    by one rename of the pointer, so readers see the old version or the new
    one. The root is a path or URI that Spark and pyarrow both reach. Beside
    the tables a version has the inventory of the rows it was made of.
    ``most_unmatched`` is how many loans may be gone without a code; None
    leaves that gate out.
    """

    def __init__(self, spark: SparkSession, root: str, most_unmatched: int | None = 0):
        self.spark, self.root, self.most_unmatched = spark, root.rstrip("/"), most_unmatched
        self._lists: dict[str, dict] = {}

    @property
    def pointer(self) -> str:
        return storage.joined(self.root, "current.json")

    def current(self) -> str | None:
        return json.loads(storage.read_text(self.pointer))["version"] if storage.exists(self.pointer) else None

    def path(self, version: str, table: str) -> str:
        return storage.joined(self.root, version, table)

    def listed(self, version: str) -> dict:
        """By table: its schema, and the periods read from each version's folders (None: a whole table)."""
        if version not in self._lists:
            self._lists[version] = json.loads(storage.read_text(storage.joined(self.root, version, "tables.json")))
        return self._lists[version]

    def table(self, version: str, name: str) -> DataFrame:
        entry = self.listed(version)[name]
        schema, out = T.StructType.fromJson(entry["schema"]), None
        for writer, periods in entry["from"].items():
            if periods is None:
                return self.spark.read.schema(schema).parquet(self.path(writer, name))
            rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("p", T.StringType())])).parquet(self.path(writer, name))
            rows = rows.where(F.col("p").isin(periods)).drop("p")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], schema) if out is None else out

    def load(self, version: str | None = None) -> Tables:
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(f"no version below {self.root}")
        return Tables(*[self.table(version, n) for n in NAMES])

    def inventory(self, version: str | None = None) -> DataFrame:
        return self.table(version or self.current(), "inventory")

    def put(self, version: str, name: str, df: DataFrame, base: str | None = None, replaced: list[str] = ()) -> DataFrame:
        """Write a table of a version and read it back; with a ``base`` version, only the periods that are ``replaced`` in it."""
        own = self._lists.setdefault(version, {})
        path = self.path(version, name)
        if name in WHOLE:
            df.write.parquet(path)
            own[name] = {"schema": df.schema.jsonValue(), "from": {version: None}}
            return self.table(version, name)
        df.withColumn("p", F.col("reporting_period")).repartition("p").write.partitionBy("p").parquet(path)
        before = self.listed(base)[name]["from"] if base else {}
        kept = {v: [p for p in periods if p not in set(replaced)] for v, periods in before.items()}
        mine = [unquote(n.removeprefix("p=")) for n in storage.names(path) if n.startswith("p=")]
        own[name] = {"schema": df.schema.jsonValue(), "from": {v: p for v, p in {**kept, version: mine}.items() if p}}
        return self.table(version, name)

    def keep(self, version: str, name: str, base: str) -> None:
        """A table of the base version, as it is."""
        self._lists.setdefault(version, {})[name] = self.listed(base)[name]

    def periods(self, version: str, name: str) -> set[str]:
        """The periods of a table that lies by period."""
        return {p for periods in self.listed(version)[name]["from"].values() for p in periods}

    def seal(self, version: str) -> None:
        storage.write_text(storage.joined(self.root, version, "tables.json"), json.dumps(self._lists[version]))

    def writers(self, version: str) -> set[str]:
        """The versions whose folders a version reads."""
        return {version, *(v for entry in self.listed(version).values() for v in entry["from"])}

    def write(self, rows: DataFrame, step: str = "month", cutover: str = CREDIT_CUTOVER, release: DataFrame | None = None, groups: int | None = None, source: DataFrame | None = None, stock: DataFrame | None = None) -> dict:
        """Write and check a version, then make it current. A failed gate leaves the former one current.

        ``release`` is an outside aggregate to reconcile with; without one,
        ``source`` (the foundation that ``rows`` were typed from) gives the
        control path's own. ``stock`` is an inventory of the rows, if there is one.
        """
        began = time.perf_counter()
        version = f"v-{uuid.uuid4().hex[:12]}"
        put = lambda name, df: self.put(version, name, df)
        aggregates = lambda: control.release_aggregate(source) if source is not None and release is None else release

        def looked_over() -> tuple[DataFrame, DataFrame | None]:
            """The inventory, and the counters of the gate of inputs where the same read gave them."""
            if stock is not None:
                put("layers", components.risk_layers(rows))
                return put("inventory", stock), None
            found = cut(survey(rows))
            put("layers", components.layers_of_sums(found))
            counts = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", *GATES)])
            return put("inventory", found.select("deal_id", "reporting_period", "records", "upb", "content")), counts

        pool_c, (held, counts), release, *_ = side_by_side(
            lambda: put("pool_components", components.pool_components(rows)),
            looked_over,
            lambda: None if (r := aggregates()) is None else cut(r),
            lambda: put("catalog", catalog(self.spark)),
        )
        deal_c = put("deal_components", components.rolled_up(pool_c, components.DEAL))

        def upper() -> None:
            portfolio_c = put("portfolio_components", components.rolled_up(deal_c, components.PORTFOLIO))
            deal, portfolio = side_by_side(lambda: put("deal", components.metrics(deal_c, components.DEAL)), lambda: put("portfolio", components.metrics(portfolio_c, components.PORTFOLIO)))
            put("decomposition", attribution.decomposition(deal, portfolio))

        def moves() -> DataFrame:
            sums = cut(flow.totals(rows, step, cutover, seen_in(deal_c)))
            put("flow", flow.measured(sums))
            return sums

        sums, *_ = side_by_side(moves, upper, lambda: put("pool", components.metrics(pool_c, components.POOL)))
        facts = self.check(version, rows, sums, held, release, groups, counts=counts)
        self.seal(version)
        self.publish(version)
        return {"version": version, **facts, "seconds": round(time.perf_counter() - began, 3)}

    def check(self, version: str, rows: DataFrame, sums: DataFrame, stock: DataFrame, release: DataFrame | None, groups: int | None = None, only: DataFrame | None = None, counts: DataFrame | None = None) -> dict:
        """All gates over a written version; GateError if one fails. ``only``: the keys that ``rows`` and ``release`` are of; ``counts``: their input gate counts, if a read gave them."""
        done = self.load(version)

        def whole() -> None:
            stored = stock.agg(F.sum("records").alias("n")).first()["n"] or 0
            if (aggregated := done.portfolio_components.agg(F.sum("in_scope_records").alias("n")).first()["n"] or 0) != stored:
                raise control.GateError(f"{stored} records came in, {aggregated} were aggregated")

        def reconciled() -> None:
            if release is not None:
                pools = done.pool if only is None else done.pool.join(only, ["deal_id", "reporting_period"], "left_semi")
                summary = control.reconciliation_summary(control.reconciliation(pools, release))
                control.check_reconciliation(summary, groups if groups is not None else release.count())

        def identity() -> None:
            if not done.decomposition.isEmpty():
                control.check_identity(attribution.identity_variance(done.decomposition, done.portfolio))

        passed, _, _, _, audit, _ = side_by_side(
            lambda: control.check_inputs(control.input_gate_counts(rows) if counts is None else counts),
            lambda: control.check_unique(sums),
            whole,
            reconciled,
            lambda: control.check_transitions(control.transition_audit(done.flow), self.most_unmatched),
            identity,
        )
        return {"records": passed["records"], "transitions": audit}

    def publish(self, version: str) -> None:
        storage.write_text(self.pointer, json.dumps({"version": version}))

    def fingerprints(self, version: str, cutoff: str | None = None) -> dict[str, tuple]:
        tables = self.load(version)
        return {n: tuple(control.fingerprint(getattr(tables, n), cutoff).first()) for n in NAMES if "reporting_period" in getattr(tables, n).columns}


def from_foundation(foundation: DataFrame, step: str = "month", cutover: str = CREDIT_CUTOVER) -> Tables:
    return build(typed(foundation, step), step, cutover)


def latest_period(portfolio: DataFrame) -> str | None:
    return portfolio.agg(F.max("reporting_period")).first()[0]
