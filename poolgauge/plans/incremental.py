"""Append-only refresh: new (deal, period) keys only, whenever they fall; history is referred to, and what is written again of it is checked."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolgauge import storage
from poolgauge.functions.columns import period_of, shifted
from poolgauge.functions.measures import CREDIT_CUTOVER
from poolgauge.operators import attribution, components, control, flow
from poolgauge.operators.control import GateError
from poolgauge.operators.typed import typed
from poolgauge.plans.tables import NAMES, Store, Tables, inventory, seen_in
from poolgauge.sources.foundation import Foundation
from poolgauge.storage import cut, side_by_side

KEYS = ["deal_id", "reporting_period"]


def moved(keys: DataFrame, step: str) -> DataFrame:
    """Keys of flow that new (deal, period, date) keys touch: their own, and the next period's, whose prior they are."""
    after = F.col("period_date")
    return keys.select(*KEYS).unionByName(keys.select("deal_id", period_of(shifted(after, 1, step), step).alias("reporting_period"))).distinct()


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.DoubleType)


def digests(tables: Tables) -> DataFrame:
    """table_name, column_name, rows and the exact sum of every column of numbers (values to eight places), in four places, of all tables that have any."""
    out = None
    for n in NAMES:
        table = getattr(tables, n)
        columns = [f.name for f in table.schema if isinstance(f.dataType, _NUMBERS)]
        if not columns:
            continue
        # doubles are summed as decimals of eight places: a sum of doubles depends on its order, and large ones do in the places that are kept
        total = lambda c: F.coalesce(F.round(F.sum(F.col(c).cast("decimal(38,8)")), 4).cast("decimal(38,4)"), F.lit(0).cast("decimal(38,4)")).cast("string").alias(c)
        one = table.agg(F.count("*").alias("rows"), *[total(c) for c in columns]).unpivot("rows", columns, "column_name", "total")
        one = one.select(F.lit(n).alias("table_name"), "column_name", "rows", "total")
        out = one if out is None else out.unionByName(one)
    return out


class Journal:
    """Run records as JSON files: running, then pass or failed; a run found running by a later one is recovered."""

    def __init__(self, root: str, keep: int = 12):
        self.folder, self.keep = storage.joined(root, "runs"), keep

    def _write(self, run: dict) -> dict:
        storage.write_text(storage.joined(self.folder, f"{run['run_id']}.json"), json.dumps(run, sort_keys=True, default=str))
        return run

    def runs(self) -> list[dict]:
        found = [json.loads(storage.read_text(storage.joined(self.folder, n))) for n in storage.names(self.folder) if n.endswith(".json") and not n.startswith(".")]
        return sorted(found, key=lambda r: r["started"])

    def frame(self, spark: SparkSession) -> DataFrame:
        """The run records as a table: run_id, kind, status, started, ended, version and error."""
        names = ("run_id", "kind", "status", "started", "ended", "version", "error")
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.runs()], "run_id string, kind string, status string, started long, ended long, version string, error string")

    def start(self, **facts) -> dict:
        return self._write({"run_id": f"run-{time.time_ns()}-{uuid.uuid4().hex[:6]}", "started": time.time_ns(), "status": "running", **facts})

    def end(self, run: dict, status: str, **facts) -> dict:
        done = self._write({**run, "status": status, "ended": time.time_ns(), **facts})
        for old in self.runs()[: -self.keep]:
            storage.remove(storage.joined(self.folder, f"{old['run_id']}.json"))
        return done

    def recover(self, store: Store) -> list[str]:
        """Mark interrupted runs; versions of which the current one reads nothing go."""
        done = []
        for run in self.runs():
            if run["status"] == "running":
                self._write({**run, "status": "recovered"})
                done.append(run["run_id"])
        used = store.writers(store.current()) if done and store.current() else set()
        for n in storage.names(store.root):
            if done and n.startswith("v-") and n not in used:
                storage.remove(storage.joined(store.root, n))
        return done


def extend(store: Store, current: str, version: str, keys: DataFrame, fresh: DataFrame, around, step: str = "month", cutover: str = CREDIT_CUTOVER) -> DataFrame:
    """Write a version that adds ``keys`` (deal_id, reporting_period, period_date; late or not) to the current one; the totals of flow taken anew.

    Each table has only the periods written that new rows touch; those of
    ``fresh`` (typed rows of the keys), the next observed ones of late keys in
    metrics, the next ones in flow and decomposition. ``around``, called with
    keys as a list, gives the typed rows of some partitions.
    """
    base = store.load(current)
    put = lambda name, df, periods: store.put(version, name, df, current, periods)
    named = [tuple(r) for r in keys.collect()]  # one per new partition
    new_periods = sorted({p for _, p, _ in named})
    of_periods = lambda table, periods: table.where(F.col("reporting_period").isin(periods))

    new_pool_c = cut(components.pool_components(fresh))
    new_deal_c = cut(components.rolled_up(new_pool_c, components.DEAL))

    def added(name: str, new: DataFrame) -> DataFrame:
        """New rows beside the history's rows of their periods, which stay as they are."""
        if not store.periods(current, name) & set(new_periods):
            return put(name, new, new_periods)
        had = of_periods(getattr(base, name), new_periods)
        now = put(name, had.unionByName(new), new_periods)
        before, after = (control.fingerprint(t).first() for t in (had, of_periods(now, new_periods).join(keys, KEYS, "left_anti")))
        if before != after:
            raise GateError(f"history changed: {name}")
        return now

    def metrics(name: str, new: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return put(name, *components.extended(getattr(base, name), new, by, store.periods(current, name)))

    def portfolio_and_effects() -> None:
        touched_c = components.rolled_up(of_periods(deal_c, new_periods), components.PORTFOLIO)
        portfolio_c = put("portfolio_components", base.portfolio_components.where(~F.col("reporting_period").isin(new_periods)).unionByName(touched_c), [])
        portfolio, deal = side_by_side(lambda: put("portfolio", components.metrics(portfolio_c, components.PORTFOLIO), []), lambda: metrics("deal", new_deal_c, components.DEAL))
        order = [r[0] for r in portfolio.select("reporting_period", "period_date").orderBy("period_date").collect()]  # the panel's periods
        spans = sorted({q for a, q in zip([None, *order], order) if q in new_periods or a in new_periods})
        sides = {*spans, *(a for a, q in zip(order, order[1:]) if q in spans)}
        effects = attribution.decomposition(of_periods(deal, list(sides)), of_periods(portfolio, list(sides)))
        put("decomposition", of_periods(effects, spans), spans)

    def flows() -> DataFrame:
        touched = cut(moved(keys, step))
        near = keys.select(*KEYS)
        for n in (-1, 1):
            near = near.unionByName(keys.select("deal_id", period_of(shifted(F.col("period_date"), n, step), step).alias("reporting_period")))
        sums = flow.totals(around([tuple(r) for r in near.distinct().collect()]), step, cutover, seen_in(deal_c))
        sums = cut(sums.join(touched, KEYS, "left_semi"))
        periods = sorted({r[0] for r in touched.select("reporting_period").distinct().collect()})
        put("flow", of_periods(base.flow, periods).join(touched, KEYS, "left_anti").unionByName(flow.measured(sums)), periods)
        return sums

    deal_c, *_ = side_by_side(lambda: added("deal_components", new_deal_c), lambda: added("pool_components", new_pool_c), lambda: added("layers", components.risk_layers(fresh)), lambda: metrics("pool", new_pool_c, components.POOL))
    sums, _ = side_by_side(flows, portfolio_and_effects)
    store.keep(version, "catalog", current)
    return sums


class _Offer:
    """What a refresh takes rows from: typed rows, or a stored foundation, of which it reads the manifest and the partitions it needs."""

    def __init__(self, rows: DataFrame | Foundation, step: str, source: DataFrame | None):
        self.rows, self.step, self.source = rows, step, source
        self.stored = isinstance(rows, Foundation)

    def inventory(self) -> DataFrame:
        return self.rows.facts() if self.stored else cut(inventory(self.rows))

    def all_rows(self) -> DataFrame:
        return typed(self.rows.read(), self.step) if self.stored else self.rows

    def release(self, keys: list[tuple[str, str]] | None = None) -> DataFrame | None:
        """The control path over the source of all partitions or of some; None if it has none."""
        if self.stored:
            return control.release_aggregate(self.rows.read(keys))
        if self.source is None or keys is None:
            return None if self.source is None else control.release_aggregate(self.source)
        return control.release_aggregate(self._of(self.source, keys, "period"))

    def some(self, keys: list[tuple[str, str]]) -> DataFrame:
        if self.stored:
            return typed(self.rows.read(keys), self.step)
        return self._of(self.rows, keys, "reporting_period")

    @staticmethod
    def _of(rows: DataFrame, keys: list[tuple[str, str]], period: str) -> DataFrame:
        named = rows.sparkSession.createDataFrame(sorted(keys), "d string, p string")
        return rows.join(F.broadcast(named), (F.col("deal_id") == F.col("d")) & (F.col(period) == F.col("p")), "left_semi")  # a row per new partition


def refresh(spark: SparkSession, store: Store, rows: DataFrame | Foundation, step: str = "month", cutover: str = CREDIT_CUTOVER, source: DataFrame | None = None) -> dict:
    """Bring the store up to ``rows``: a full version first, deltas after it; a no-op without new keys.

    ``rows`` are all rows so far, typed, or a stored foundation. A committed
    (deal, period) that lacks or differs fails the run; new ones are taken
    whenever they fall, also before periods that other deals already have. Of
    a foundation only the manifest is compared, and a delta reads the new
    partitions and their neighbours; typed rows are hashed to be compared.
    ``source`` (what typed rows were typed from) has the metrics reconciled
    with the control path, which a foundation always has.
    """
    journal, offer = Journal(store.root), _Offer(rows, step, source)
    recovered = journal.recover(store)
    current = store.current()
    if current is None:
        run = journal.start(kind="full")
        try:
            stock = offer.inventory() if offer.stored else None
            return journal.end(run, "pass", recovered=recovered, **store.write(offer.all_rows(), step, cutover, release=offer.release(), stock=stock))
        except Exception as e:
            journal.end(run, "failed", error=str(e)[:500])
            raise
    run = journal.start(kind="delta")
    try:
        offered = offer.inventory()
        diff = cut(control.append_only_diff(store.inventory(current), offered))
        if not control.check_append_only(diff).get("new"):
            return journal.end(run | {"kind": "no-op"}, "pass", version=current, recovered=recovered)
        new = [(r["deal_id"], r["reporting_period"]) for r in diff.where("change = 'new'").collect()]  # one per partition folder
        fresh = offer.some(new)
        keys = cut(fresh.select(*KEYS, "period_date").distinct())
        version = f"v-{uuid.uuid4().hex[:12]}"
        sums = extend(store, current, version, keys, fresh, offer.some, step, cutover)
        stock = store.put(version, "inventory", offered)
        store.check(version, fresh, sums, stock, offer.release(new), only=keys)
        store.seal(version)
        store.publish(version)
        return journal.end(run, "pass", version=version, recovered=recovered)
    except Exception as e:
        journal.end(run, "failed", error=str(e)[:500])
        raise
