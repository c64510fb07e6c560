"""Queries over the monthly and daily lenses, with their DuckDB SQL."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Callable
from functools import partial
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolgauge import oracle as o
from poolgauge.functions.catalog import ENTRIES, catalog
from poolgauge.functions.columns import LABELS, label, record_status
from poolgauge.functions.layout import FIELD_NAMES
from poolgauge.operators import attribution, baseline, components, control, flow, masking
from poolgauge.operators.typed import typed
from poolgauge.plans import endpoints, incremental, pages, projection, release
from poolgauge.plans.surface import Surface
from poolgauge.plans.tables import Store, Tables, build
from poolgauge.sources import archive, lens
from poolgauge.sources.foundation import Foundation
from poolgauge.storage import joined, shared_dir, write_whole

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: On this lens both lists of credit-event codes occur.
CUTOVER = o.CUTOVER
#: Key of the masked queries; a deployment has its own and passes it as a column.
DEMO_KEY = "00112233445566778899aabbccddeeff00112233445566778899aabbccddeeff"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def foundation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.monthly(table(spark, sf_dir, "orders"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(foundation(spark, sf_dir))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple:
    """What the panel's input is now: its files with their lengths and times of change, read without a column."""
    found = table(spark, sf_dir, "orders").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(sorted(map(tuple, found.collect())))


#: By application and folder: the input it was made of, and the store.
_stores: dict[tuple[str, str], tuple[tuple, Store]] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The metric store over a folder's panel, written and gated once per application and input: what ranks, pages and explains reads its tables."""
    key, inputs = (spark.sparkContext.applicationId, sf_dir), _inputs(spark, sf_dir)
    if key not in _stores or _stores[key][0] != inputs:
        # loans of this lens end after eight months, with or without a code
        made = Store(spark, joined(shared_dir(spark), f"panel-{uuid.uuid4().hex}"), most_unmatched=None)
        made.write(panel(spark, sf_dir), cutover=CUTOVER, source=foundation(spark, sf_dir))
        _stores[key] = inputs, made
    return _stores[key][1]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return store(spark, sf_dir).load()


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


LATEST = o.LATEST


@query(o.q(o.TYPED, "SELECT * FROM typed"))
def typed_panel(spark, sf):
    return panel(spark, sf)


@query(o.q(o.TYPED, """SELECT count(*) AS records, count(*) FILTER (WHERE current_upb IS NULL OR current_upb < 0) AS invalid_upb,
  count(*) FILTER (WHERE delinquency_months IS NULL AND delinquency_status_raw NOT IN ('RA','XX')) AS invalid_status, count(*) FILTER (WHERE pool_construct = 'unknown') AS unknown_construct FROM typed"""))
def input_gate_counts(spark, sf):
    return control.input_gate_counts(panel(spark, sf))


@query(o.q(o.COMPONENT_CTES, "SELECT * FROM pool_c"))
def pool_components(spark, sf):
    return components.pool_components(panel(spark, sf))


@query(o.q(o.COMPONENT_CTES, "SELECT * FROM deal_c"))
def deal_components(spark, sf):
    return components.deal_components(panel(spark, sf))


@query(o.q(o.COMPONENT_CTES, "SELECT * FROM portfolio_c"))
def portfolio_components(spark, sf):
    return components.portfolio_components(panel(spark, sf))


@query(o.q(o.METRIC_CTES, "SELECT * FROM pool_m"))
def pool_metrics(spark, sf):
    return components.pool_metrics(panel(spark, sf))


@query(o.q(o.METRIC_CTES, "SELECT * FROM deal_m"))
def deal_metrics(spark, sf):
    return components.deal_metrics(panel(spark, sf))


@query(o.q(o.METRIC_CTES, "SELECT * FROM portfolio_m"))
def portfolio_metrics(spark, sf):
    return components.portfolio_metrics(panel(spark, sf))


@query(o.q(o.METRIC_CTES, f"SELECT {o.SHOWN} FROM deal_m"))
def deal_metrics_shown(spark, sf):
    return endpoints.shown(components.deal_metrics(panel(spark, sf)))


@query(o.q(o.FLOW_CTES, "SELECT * FROM flow"))
def flow_metrics(spark, sf):
    return flow.flow_metrics(panel(spark, sf), cutover=CUTOVER)


@query(o.q(o.FLOW_CTES, "SELECT deal_id, reporting_period, pool_construct, zero_balance_code, count(*) AS loans, CAST(sum(prior_upb) AS DECIMAL(24,2)) AS prior_upb FROM pairs WHERE is_matched AND prior_zero_balance_code IS NULL AND zero_balance_code IS NOT NULL GROUP BY ALL"))
def credit_exit_by_construct(spark, sf):
    left = flow.pairs(panel(spark, sf)).where("is_matched AND prior_zero_balance_code IS NULL AND zero_balance_code IS NOT NULL")
    return left.groupBy("deal_id", "reporting_period", "pool_construct", "zero_balance_code").agg(F.count("*").alias("loans"), F.sum("prior_upb").cast("decimal(24,2)").alias("prior_upb"))


@query(o.q(o.FLOW_CTES, """SELECT CASE WHEN is_matched THEN 'matched' WHEN prior_zero_balance_code IS NOT NULL THEN 'approved_exit' ELSE 'error_unmatched' END AS row_class, count(*) AS records FROM pairs GROUP BY ALL
  UNION ALL SELECT 'new', CAST(coalesce(sum(new_records), 0) AS BIGINT) FROM fresh"""))
def prior_row_classes(spark, sf):
    return flow.prior_row_classes(panel(spark, sf))


@query(o.q(o.FLOW_CTES, "SELECT prior_state, performance_state AS state, count(*) AS loans, CAST(coalesce(sum(prior_upb), 0) AS DECIMAL(24,2)) AS prior_upb FROM pairs WHERE is_matched GROUP BY ALL"))
def transition_matrix(spark, sf):
    return flow.transition_matrix(panel(spark, sf))


@query(o.q(o.FLOW_CTES, "SELECT " + ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in ("prior_records", "matched_records", "approved_exit_records", "revision_exception_records", "error_unmatched_records", "new_records")) + ", min(loan_match_rate) AS minimum_deal_period_match_rate FROM flow"))
def transition_audit(spark, sf):
    return control.transition_audit(flow.flow_metrics(panel(spark, sf), cutover=CUTOVER))


@query(o.q(o.TYPED + o.LAYERS, "SELECT * FROM layers"))
def risk_layer_shares(spark, sf):
    return components.risk_layers(panel(spark, sf))


@query(o.q(o.TYPED + o.LAYERS, """SELECT k.deal_id, k.reporting_period, k.period_date, g AS risk_layer_count, coalesce(l.eligible_loans, 0) AS eligible_loans, coalesce(l.eligible_current_upb, CAST(0 AS DECIMAL(24,2))) AS eligible_current_upb,
  coalesce(l.loan_share, 0) AS loan_share, coalesce(l.upb_share, 0) AS upb_share FROM (SELECT deal_id, reporting_period, period_date, CAST(unnest(generate_series(0, 4)) AS INTEGER) AS g FROM (SELECT DISTINCT deal_id, reporting_period, period_date FROM layers)) k
  LEFT JOIN layers l ON l.deal_id = k.deal_id AND l.reporting_period = k.reporting_period AND l.risk_layer_count = k.g"""))
def risk_layers_dense(spark, sf):
    return components.risk_layers_dense(components.risk_layers(panel(spark, sf)))


@query(o.q(o.METRIC_CTES + o.DECOMPOSITION, "SELECT * FROM effects"))
def rate_mix_decomposition(spark, sf):
    return tables(spark, sf).decomposition


@query(o.q(o.METRIC_CTES + o.DECOMPOSITION, "SELECT reporting_period, round(abs(sum(rate_effect_bps + mix_effect_bps) - any_value(p.d60_change_1m_bps)), 6) AS variance_bps FROM effects JOIN portfolio_m p USING (reporting_period) GROUP BY reporting_period"))
def decomposition_identity(spark, sf):
    t = tables(spark, sf)
    return attribution.identity_variance(t.decomposition, t.portfolio)


@query(o.q(o.METRIC_CTES + o.DECOMPOSITION, "SELECT reporting_period, round(sum(rate_effect_bps), 9) AS rate_effect_bps, round(sum(mix_effect_bps), 9) AS mix_effect_bps, round(sum(total_contribution_bps), 9) AS total_contribution_bps FROM effects GROUP BY ALL"))
def decomposition_totals(spark, sf):
    return attribution.decomposition_totals(tables(spark, sf).decomposition)


@query(o.q(o.METRIC_CTES + o.RELEASE, "SELECT * FROM release"))
def release_aggregate(spark, sf):
    return control.release_aggregate(foundation(spark, sf))


def _release_folder(spark, sf):
    return _made(spark, sf, "release", lambda folder: release.rebuilt_if_behind(spark, folder, foundation(spark, sf), "synthetic-fixture"))


@query(o.q(o.LENS + o.RELEASE_ONLY, "SELECT reporting_period, deal_id, reference_pool_number, CAST(current_upb AS DOUBLE) AS current_upb, CAST(d30_plus_upb AS DOUBLE) AS d30_plus_upb, CAST(d60_plus_upb AS DOUBLE) AS d60_plus_upb, d30_plus_rate, d60_plus_rate, records_aggregated, ra_records, xx_records, 'synthetic-fixture' AS source_classification FROM release"))
def release_csv(spark, sf):
    """The release aggregate written as CSV and read by its fixed types."""
    return release.read_csv(spark, _release_folder(spark, sf))


@query(o.q(o.LENS + o.RELEASE_ONLY, "SELECT count(*) AS groups, CAST(0 AS BIGINT) AS unordered_balances, CAST(0 AS BIGINT) AS wrong_rates FROM release"))
def release_rule_breaks(spark, sf):
    return release.rule_breaks(release.read_csv(spark, _release_folder(spark, sf)))


def _reconciled(spark, sf):
    return control.reconciliation(components.pool_metrics(panel(spark, sf)), control.release_aggregate(foundation(spark, sf)))


@query(o.q(o.METRIC_CTES + o.RELEASE, "SELECT * FROM reconciled"))
def reconciliation(spark, sf):
    return _reconciled(spark, sf)


@query(o.q(o.METRIC_CTES + o.RELEASE, "SELECT count(*) AS groups, " + ", ".join(f"max(abs(CAST({v} AS DOUBLE))) AS max_{v}" for v in control.VARIANCES) + ", count(*) FILTER (WHERE missing_group) AS missing_groups FROM reconciled"))
def reconciliation_summary(spark, sf):
    return control.reconciliation_summary(_reconciled(spark, sf))


def _watchlist(spark, sf, measure):
    return endpoints.watchlist(tables(spark, sf), sort=measure)


for _m in endpoints.SORTS:
    QUERIES[f"watchlist_{_m}"] = partial(_watchlist, measure=_m)
    SQL[f"watchlist_{_m}"] = o.watchlist(_m)


QUERIES["watchlist_ascending"] = lambda spark, sf: endpoints.watchlist(tables(spark, sf), sort="d60_plus_rate", descending=False)
SQL["watchlist_ascending"] = o.watchlist("d60_plus_rate", "ASC")


@query(o.q(o.FLOW_CTES, "SELECT * FROM flow WHERE deal_id = 'D3'"))
def deal_flow(spark, sf):
    return tables(spark, sf).flow.where("deal_id = 'D3'")


@query(o.q(o.TYPED + o.LAYERS, "SELECT risk_layer_count, eligible_loans, eligible_current_upb, loan_share, upb_share, metric_version FROM layers WHERE deal_id = 'D3' AND reporting_period = '199807'"))
def deal_layers(spark, sf):
    return endpoints.deal_view(tables(spark, sf), "D3", "199807")["risk_layers"]


@query(o.q(o.METRIC_CTES + o.DECOMPOSITION, "SELECT reporting_period, deal_id, total_contribution_bps, row_number() OVER (PARTITION BY reporting_period ORDER BY abs(total_contribution_bps) DESC, deal_id) AS rank FROM effects QUALIFY rank <= 10"))
def driver_ranking(spark, sf):
    order = Window.partitionBy("reporting_period").orderBy(F.abs("total_contribution_bps").desc(), "deal_id")
    return tables(spark, sf).decomposition.select("reporting_period", "deal_id", "total_contribution_bps", F.row_number().over(order).cast("bigint").alias("rank")).where(F.col("rank") <= 10)


@query(o.q(o.METRIC_CTES + o.DECOMPOSITION, "SELECT reporting_period, deal_id, total_contribution_bps FROM effects QUALIFY row_number() OVER (PARTITION BY reporting_period ORDER BY total_contribution_bps DESC, deal_id DESC) = 1"))
def top_contributor(spark, sf):
    best = F.max(F.struct("total_contribution_bps", "deal_id")).alias("s")
    return tables(spark, sf).decomposition.groupBy("reporting_period").agg(best).select("reporting_period", F.col("s.deal_id").alias("deal_id"), F.col("s.total_contribution_bps").alias("total_contribution_bps"))


@query(o.q(o.METRIC_CTES, """SELECT d.deal_id, d.reporting_period, d.d60_plus_rate, p.d60_plus_rate AS portfolio_d60_plus_rate, (d.d60_plus_rate - p.d60_plus_rate) * 10000 AS difference_bps
  FROM (SELECT * FROM deal_m QUALIFY row_number() OVER (PARTITION BY deal_id ORDER BY period_date DESC) <= 18) d JOIN portfolio_m p USING (reporting_period)"""))
def deal_series_vs_portfolio(spark, sf):
    return endpoints.series_against_portfolio(tables(spark, sf))


@query(o.q(o.METRIC_CTES, "SELECT reference_pool_number, eligible_active_loans, eligible_current_upb, d30_plus_rate, d60_plus_rate, d90_plus_rate, d60_change_1m_bps, assistance_exposure_share, new_modification_rate_count, metric_version FROM pool_m WHERE deal_id = 'D3' AND reporting_period = '199807'"))
def pool_ranking(spark, sf):
    return endpoints.pool_ranking(tables(spark, sf), "D3", "199807")


@query(o.q(o.METRIC_CTES, "SELECT reporting_period, d30_plus_rate, d60_plus_rate, d90_plus_rate, d60_change_1m_bps, eligible_current_upb FROM deal_m WHERE deal_id = 'D3' AND reporting_period <= '199807'"))
def deal_series(spark, sf):
    return endpoints.deal_series(tables(spark, sf), "D3", "199807")


_ROWS = ", ".join(endpoints._ROW)


@query(o.q(o.TYPED, f"SELECT 'restricted-' || right(loan_identifier, 4) AS loan_identifier, {_ROWS} FROM (SELECT * FROM typed WHERE deal_id = 'D3' AND reporting_period = '199807' ORDER BY risk_layer_count DESC NULLS LAST, delinquency_months DESC NULLS LAST, current_upb DESC NULLS LAST, loan_identifier LIMIT 50 OFFSET 10)"))
def loan_page_private(spark, sf):
    return endpoints.loan_page(panel(spark, sf), "199807", "D3", limit=50, offset=10)[1]


@query(o.q(o.TYPED, f"SELECT 'restricted-' || right(loan_identifier, 4) AS loan_identifier, {_ROWS} FROM (SELECT * FROM typed WHERE deal_id = 'D3' AND reporting_period = '199807' AND performance_state = 'D60' AND risk_layer_count = 1 ORDER BY risk_layer_count DESC NULLS LAST, delinquency_months DESC NULLS LAST, current_upb DESC NULLS LAST, loan_identifier LIMIT 50)"))
def loan_page_filtered(spark, sf):
    return endpoints.loan_page(panel(spark, sf), "199807", "D3", status="d60", layer=1)[1]


@query(SQL["loan_page_private"])
def loan_page_by_cursor(spark, sf):
    """The page behind the tenth row, found by that row's cursor instead of an offset."""
    rows = panel(spark, sf)
    after = pages.last_cursor(endpoints.loan_page_after(rows, "199807", "D3", limit=10), 10)
    return endpoints.loan_page_after(rows, "199807", "D3", limit=50, after=after).drop("cursor")


def _masked_partition(spark, sf):
    here = foundation(spark, sf).where((F.col("deal_id") == "D3") & (F.col("period") == "199807"))
    return masking.masked(here, DEMO_KEY)


def _public(spark, sf, status):
    return endpoints.public_page(_masked_partition(spark, sf), status)[1].select("deal_id", *o.FIELDS_OF_LENS)


_PUBLIC_WHERE = {"all": "TRUE", "current": "current_loan_delinquency_status = '00'", "d30": "current_loan_delinquency_status = '01'", "d60": "current_loan_delinquency_status = '02'", "d90": "try_cast(current_loan_delinquency_status AS INTEGER) >= 3", "reo": "current_loan_delinquency_status = 'RA'", "zero_balance": "zero_balance_code IS NOT NULL AND zero_balance_code <> ''"}
_MASK = f"* REPLACE ({o._token('loan_identifier', 'loan-', 20, DEMO_KEY)} AS loan_identifier, {o._token('postal_code_3_digit', 'geo-', 12, DEMO_KEY)} AS postal_code_3_digit)"
_MASKED = o.LENS + f", masked AS (SELECT {_MASK} FROM panel)"
for _s in endpoints.PUBLIC_STATES:
    QUERIES[f"loan_page_public_{_s}"] = partial(_public, status=_s)
    SQL[f"loan_page_public_{_s}"] = o.q(_MASKED, f"SELECT deal_id, {', '.join(o.FIELDS_OF_LENS)} FROM masked WHERE deal_id = 'D3' AND period = '199807' AND {_PUBLIC_WHERE[_s]} ORDER BY try_cast(current_loan_delinquency_status AS INTEGER) DESC NULLS LAST, try_cast(current_actual_upb AS DOUBLE) DESC NULLS LAST, loan_identifier LIMIT 50")


@query(SQL["loan_page_public_all"].replace("LIMIT 50", "LIMIT 50 OFFSET 10"))
def loan_page_public_by_cursor(spark, sf):
    rows = _masked_partition(spark, sf)
    after = pages.last_cursor(endpoints.public_page_after(rows, limit=10), 10)
    return endpoints.public_page_after(rows, after=after).select("deal_id", *o.FIELDS_OF_LENS)


@query(o.q(_MASKED, f"SELECT deal_id, {', '.join(o.FIELDS_OF_LENS)} FROM masked"))
def masked_panel(spark, sf):
    return masking.masked(foundation(spark, sf), DEMO_KEY).select("deal_id", *o.FIELDS_OF_LENS)


@query(o.q(_MASKED, r"SELECT count(*) AS records, count(DISTINCT deal_id || '|' || period) AS partitions, count(*) FILTER (WHERE NOT regexp_full_match(loan_identifier, 'loan-[0-9a-f]{20}')) AS invalid_loan_tokens, count(*) FILTER (WHERE NOT regexp_full_match(postal_code_3_digit, 'geo-[0-9a-f]{12}')) AS invalid_geo_tokens FROM masked"))
def mask_token_audit(spark, sf):
    return masking.token_audit(masking.masked(foundation(spark, sf), DEMO_KEY))


_FIELDS = tuple(o.FIELDS_OF_LENS)


@query(o.q(o.LENS, " UNION ALL ".join(f"SELECT '{c}' AS field_name, count(*) AS records, count({c}) AS non_null, round(CAST(count({c}) AS DOUBLE) / count(*), 8) AS non_null_rate FROM panel" for c in _FIELDS)))
def field_profile(spark, sf):
    return control.field_profile(foundation(spark, sf), _FIELDS)


@query(o.q(o.LENS, "SELECT current_loan_delinquency_status AS status, count(*) AS records, count(*) FILTER (WHERE CAST(current_actual_upb AS DECIMAL(20,2)) = 0) AS zero_upb FROM panel GROUP BY ALL"))
def status_histogram(spark, sf):
    rows = foundation(spark, sf)
    return rows.groupBy(F.col("current_loan_delinquency_status").alias("status")).agg(F.count("*").alias("records"), F.count_if(F.col("current_actual_upb").try_cast("decimal(20,2)") == 0).alias("zero_upb"))


@query(o.q(o.LENS, "SELECT deal_id, reference_pool_number, loan_identifier, left(period, 4) AS year, count(*) AS copies FROM panel GROUP BY ALL HAVING count(*) > 7"))
def duplicate_keys(spark, sf):
    """Loans that more than seven rows of a year share: the check that intake runs by month, on a key that repeats."""
    rows = foundation(spark, sf).withColumn("year", F.left("period", F.lit(4)))
    return control.duplicate_keys(rows, "deal_id", "reference_pool_number", "loan_identifier", "year").where("copies > 7")


#: Widths by period: later disclosures have more fields. And what a delivery holds beside its regular members.
_WIDTH = "CASE WHEN period < '199501' THEN 89 WHEN period < '199701' THEN 90 ELSE 93 END"
_STRAY = ("notes.txt", "22D3_19980715_lld.txt")
#: By application, input folder and purpose: the input it was made of, and the folder that was filled.
_MADE: dict[tuple[str, str, str], tuple[tuple, str]] = {}


def _made(spark: SparkSession, sf: str, what: str, make) -> str:
    """A folder that is filled once per application and input."""
    key, inputs = (spark.sparkContext.applicationId, sf, what), _inputs(spark, sf)
    if key not in _MADE or _MADE[key][0] != inputs:
        folder = joined(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")
        make(folder)
        _MADE[key] = inputs, folder
    return _MADE[key][1]


def delivery(spark: SparkSession, sf: str) -> str:
    """The panel as a folder of disclosure archives, with a note and a revised member among them."""

    def make(folder: str) -> None:
        rows = lens.monthly(table(spark, sf, "orders"), by_year=True).withColumns({"deal_id": F.concat(F.lit("2022-"), "deal_id"), "source_field_count": F.expr(_WIDTH).cast("smallint")})
        archive.write_archives(rows, folder, whole=True)
        stray = BytesIO()
        with zipfile.ZipFile(stray, "w") as z:
            for n in _STRAY:
                z.writestr(n, "not for intake\n")
        stray.seek(0)
        write_whole(joined(folder, "stray.zip"), stray)

    return _made(spark, sf, "delivery", make)


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of :func:`stored_foundation`."""
    return stored_foundation(spark, sf).read()


def stored_foundation(spark: SparkSession, sf: str) -> Foundation:
    """The foundation that the delivery's accepted members were staged, verified and appended to."""

    def make(folder: str) -> None:
        Foundation(spark, folder).append_archive(delivery(spark, sf))

    return Foundation(spark, _made(spark, sf, "foundation", make))


_MEMBERS = o.LENS + f""", members AS (SELECT '22' || deal_id || '_' || period || '01_lld.txt' AS member, '2022-' || deal_id AS deal_id, period AS reporting_period FROM panel GROUP BY ALL
  UNION ALL SELECT 'notes.txt', NULL, NULL UNION ALL SELECT '{_STRAY[1]}', '2022-D3', '199807'),
accepted AS (SELECT '2022-' || deal_id AS deal_id, * EXCLUDE (deal_id), {_WIDTH} AS width FROM panel WHERE NOT (deal_id = 'D3' AND period = '199807'))"""


@query(o.q(_MEMBERS, "SELECT member, deal_id, reporting_period, CASE WHEN deal_id IS NULL THEN 'non-standard name' WHEN count(*) OVER (PARTITION BY deal_id, reporting_period) > 1 THEN 'duplicate or revised' END AS rejection FROM members"))
def archive_inventory(spark, sf):
    return archive.classified(archive.inventory(spark, delivery(spark, sf))).select("member", "deal_id", "reporting_period", "rejection")


@query(o.q(_MEMBERS, "SELECT deal_id, reporting_period, candidates, member FROM (SELECT *, count(*) OVER (PARTITION BY deal_id, reporting_period) AS candidates FROM members WHERE deal_id IS NOT NULL) WHERE candidates > 1"))
def duplicate_candidates(spark, sf):
    """Members that claim one deal and month together: all are refused."""
    named = archive.inventory(spark, delivery(spark, sf)).where(F.col("deal_id").isNotNull()).select("member", "deal_id", "reporting_period")
    return control.duplicate_candidates(named)


@query(o.q(_MEMBERS, "SELECT deal_id, period AS reporting_period, CAST(width AS SMALLINT) AS source_field_count, count(*) AS records, CAST(sum(CAST(current_actual_upb AS DECIMAL(20,2))) AS DECIMAL(24,2)) AS upb, count(*) FILTER (WHERE width = 93 AND actual_loss IS NOT NULL) AS with_loss, count(DISTINCT loan_identifier) AS loans FROM accepted GROUP BY ALL"))
def archive_foundation(spark, sf):
    """The accepted members read from their archives, padded and typed by position."""
    rows, _ = archive.foundation(spark, delivery(spark, sf))
    return rows.groupBy("deal_id", F.col("period").alias("reporting_period"), "source_field_count").agg(F.count("*").alias("records"), F.sum(F.col("current_actual_upb").cast("decimal(20,2)")).cast("decimal(24,2)").alias("upb"), F.count("actual_loss").alias("with_loss"), F.count_distinct("loan_identifier").alias("loans"))


@query(o.q(_MEMBERS, "SELECT '22' || right(deal_id, 2) || '_' || period || '01_lld.txt' AS source_member, count(*) AS records, count(DISTINCT width) AS widths, " + ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in archive.BROKEN) + " FROM accepted GROUP BY ALL"))
def archive_member_gates(spark, sf):
    return archive.member_gates(archive.foundation(spark, delivery(spark, sf))[0])


@query(o.q(_MEMBERS, "SELECT deal_id, period AS reporting_period, count(*) AS records, CASE WHEN right(deal_id, 1) IN ('1', '2', '3') THEN 'official' ELSE 'intake' END AS origin FROM accepted GROUP BY ALL"))
def control_totals(spark, sf):
    """Official totals of a JSON manifest where it names a deal and month, intake's own elsewhere; both agree where both are."""

    def make(folder: str) -> None:
        some = archive.stored_counts(stored(spark, sf)).where(F.right("deal_id", F.lit(1)).isin("1", "2", "3"))
        document = some.select(F.struct("deal_id", "reporting_period", "records").alias("f")).agg(F.to_json(F.struct(F.collect_list("f").alias("files"))).alias("value"))
        document.coalesce(1).write.text(folder)  # a row per deal and month

    official = archive.official_totals(spark, _made(spark, sf, "official", make))
    counts = archive.stored_counts(stored(spark, sf))
    if not archive.official_mismatches(counts, official).isEmpty():
        raise control.GateError("intake differs from the official totals")
    return release.best_totals(official, counts)


@query(o.q(_MEMBERS, "SELECT deal_id, period AS reporting_period, '22' || right(deal_id, 2) || '_' || period || '01_lld.txt' AS source_member, CAST(any_value(width) AS INTEGER) AS source_field_count, count(*) AS records, 'deal_id=' || deal_id || '/reporting_period=' || period AS path FROM accepted GROUP BY deal_id, period"))
def partition_manifest(spark, sf):
    """What the append noted of every partition it took over, after reading all of them again and comparing records and digests."""
    made = stored_foundation(spark, sf)
    made.verify()
    return made.manifest().select("deal_id", "reporting_period", "source_member", "source_field_count", "records", "path")


@query(o.q(_MEMBERS, "SELECT deal_id, period AS reporting_period, count(*) AS records, count(*) + 1 AS official_records FROM accepted WHERE deal_id = '2022-D2' AND period BETWEEN '199701' AND '199703' GROUP BY ALL"))
def official_mismatches(spark, sf):
    """Stored counts against totals taken from the orders themselves, three of which are given one too high."""
    orders = table(spark, sf, "orders").select(F.concat(F.lit("2022-D"), (F.col("o_custkey") % 10).cast("string")).alias("deal_id"), F.col("o_orderdate").cast("date").alias("d"))
    observed = orders.groupBy("deal_id", F.trunc("d", "month").alias("d")).agg(F.count("*").alias("n"))
    months = observed.select("deal_id", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "d").groupBy("deal_id", F.date_format(F.add_months("d", F.col("k")), "yyyyMM").alias("reporting_period")).agg(F.sum("n").alias("records"))
    wrong = (F.col("deal_id") == "2022-D2") & F.col("reporting_period").between("199701", "199703")
    official = months.withColumn("records", F.when(wrong, F.col("records") + 1).otherwise(F.col("records")))
    found = archive.official_mismatches(archive.stored_counts(stored(spark, sf)), official)
    return found.select("deal_id", "reporting_period", "records", "official_records")


#: How loans of some deals break intake's rules in :func:`broken_members`: one rule a deal.
_BREAKS = "loan_identifier IS NOT NULL AND CAST(loan_identifier AS BIGINT) % 97 = 0"


@query(o.q(o.LENS, f"""SELECT deal_id AS source_member, count(*) + count(*) FILTER (WHERE deal_id = 'D3' AND bad) AS records, CAST(1 AS BIGINT) AS widths, count(*) FILTER (WHERE deal_id = 'D0' AND bad) AS wrong_width, count(*) FILTER (WHERE deal_id = 'D1' AND bad) AS wrong_period,
  count(*) FILTER (WHERE deal_id = 'D2' AND bad) AS blank_identifiers, count(*) FILTER (WHERE deal_id = 'D4' AND bad) AS negative_upb, count(*) FILTER (WHERE deal_id = 'D5' AND bad) AS invalid_status,
  count(DISTINCT loan_identifier) FILTER (WHERE deal_id = 'D3' AND bad) AS duplicate_loans FROM (SELECT *, {_BREAKS} AS bad FROM panel WHERE right(period, 2) = '06') GROUP BY deal_id"""))
def broken_members(spark, sf):
    """Intake's gates over members (a deal's Junes of all years) of which six break one rule each."""
    rows = foundation(spark, sf).where(F.right("period", F.lit(2)) == "06").withColumns({"bad": F.expr(_BREAKS), "source_member": F.col("deal_id")})
    of = lambda deal: (F.col("deal_id") == deal) & F.col("bad")
    rows = rows.unionByName(rows.where(of("D3")))
    rows = rows.withColumns(
        {
            "width_accepted": ~of("D0"),
            "member_period": F.when(of("D1"), "190001").otherwise(F.col("period")),
            "reference_pool_number": F.when(of("D2"), " ").otherwise(F.col("reference_pool_number")),
            "loan_identifier": F.concat_ws(":", F.when(~of("D3"), F.col("period")), "loan_identifier"),
            "current_actual_upb": F.when(of("D4"), "-1").otherwise(F.col("current_actual_upb")),
            "current_loan_delinquency_status": F.when(of("D5"), "late").otherwise(F.col("current_loan_delinquency_status")),
        }
    )
    return archive.member_gates(rows).select("source_member", "records", "widths", *archive.BROKEN)


@query(o.q(_MEMBERS, "SELECT CAST(1 AS BIGINT) AS files, count(*) AS records FROM accepted WHERE deal_id = '2022-D3' AND period = '199706'"))
def stored_partition_scan(spark, sf):
    """What a filter on deal and month leaves to read of the stored foundation: one file."""
    return archive.files_read(stored(spark, sf).where("deal_id = '2022-D3' AND reporting_period = '199706'"))


@query(o.q(_MEMBERS, "SELECT count(*) AS records, CAST(sum(length(loan_identifier)) AS BIGINT) AS characters FROM accepted"))
def stored_column_scan(spark, sf):
    return archive.column_scan(stored(spark, sf), "loan_identifier")


@query(o.q(_MEMBERS, "SELECT deal_id, period AS reporting_period, count(*) AS records FROM accepted GROUP BY ALL"))
def masked_publication(spark, sf):
    """Masked rows published by deal and month, read back and audited."""
    return release.publish_stored(spark, stored_foundation(spark, sf), joined(shared_dir(spark), f"public-{uuid.uuid4().hex}"), DEMO_KEY)


@query(o.q(o.LENS, "SELECT deal_id, period AS reporting_period, CASE WHEN period > '199801' THEN 'planned' ELSE 'committed' END AS orphan FROM panel WHERE period > '199801' OR deal_id = 'D9' GROUP BY ALL"))
def manifest_orphans(spark, sf):
    """A plan without a deal against a manifest that ends early."""
    keys = foundation(spark, sf).select("deal_id", F.col("period").alias("reporting_period"))
    return release.orphans(keys.where("deal_id <> 'D9' OR reporting_period > '199801'"), keys.where("reporting_period <= '199801'"))


_INVENTORY = "SELECT deal_id, period AS reporting_period, count(*) AS records, CAST(sum(CAST(current_actual_upb AS DECIMAL(20,2))) AS DECIMAL(24,2)) AS upb FROM panel"


@query(o.q(o.LENS + f", had AS ({_INVENTORY} WHERE period < '200001' GROUP BY ALL), got AS ({_INVENTORY} WHERE period >= '199603' AND NOT (period = '199805' AND CAST(loan_identifier AS BIGINT) % 2 = 0) GROUP BY ALL)",
    "SELECT deal_id, reporting_period, 'missing' AS change FROM had ANTI JOIN got USING (deal_id, reporting_period) UNION ALL SELECT deal_id, reporting_period, 'new' FROM got ANTI JOIN had USING (deal_id, reporting_period) UNION ALL SELECT h.deal_id, h.reporting_period, 'changed' FROM had h JOIN got g USING (deal_id, reporting_period) WHERE h.records <> g.records OR h.upb <> g.upb"))
def append_only_diff(spark, sf):
    rows = foundation(spark, sf)
    kept = ~((F.col("period") == "199805") & (F.col("loan_identifier").cast("long") % 2 == 0))
    stock = lambda d: d.groupBy("deal_id", F.col("period").alias("reporting_period")).agg(F.count("*").alias("records"), F.sum(F.col("current_actual_upb").cast("decimal(20,2)")).cast("decimal(24,2)").alias("upb"))
    return control.append_only_diff(stock(rows.where("period < '200001'")), stock(rows.where((F.col("period") >= "199603") & kept)))


@query(o.q(o.COMPONENT_CTES, "SELECT count(*) AS records, CAST(sum(CAST(('0x' || left(md5(concat_ws('|', deal_id, reporting_period, in_scope_records, eligible_active_loans, eligible_current_upb, d30_plus_upb, d60_plus_upb)), 12)) AS BIGINT)) AS BIGINT) AS fingerprint FROM deal_c WHERE reporting_period <= '199912'"))
def history_fingerprint(spark, sf):
    """Rows and an order-free sum of row digests of the deals' history: two stores with equal ones agree on it."""
    names = ("deal_id", "reporting_period", "in_scope_records", "eligible_active_loans", "eligible_current_upb", "d30_plus_upb", "d60_plus_upb")
    digest = F.conv(F.left(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in names])), F.lit(12)), 16, 10).cast("long")
    return tables(spark, sf).deal_components.where("reporting_period <= '199912'").agg(F.count("*").alias("records"), F.sum(digest).alias("fingerprint"))


_DIGEST_OF = {"pool_components": "pool_c", "deal_components": "deal_c", "portfolio_components": "portfolio_c", "pool": "pool_m", "deal": "deal_m", "portfolio": "portfolio_m", "flow": "flow", "layers": "layers", "decomposition": "effects"}


def _sums_of(name: str, source: str) -> str:
    """Rows and sums of all columns of numbers of a relation, whatever they are: exact sums of the values' own decimals to eight places, which no order of rows changes."""
    texts = "deal_id|reference_pool_number|reporting_period|prior_reporting_period|period_date|metric_version"
    each = f"COLUMNS(lambda c: NOT regexp_full_match(c, '{texts}'))"
    return f"SELECT '{name}' AS table_name, column_name, (SELECT count(*) FROM {source}) AS rows, CAST(total AS VARCHAR) AS total FROM (UNPIVOT (SELECT coalesce(CAST(round(sum(CAST(CAST({each} AS VARCHAR) AS DECIMAL(38,8))), 4) AS DECIMAL(38,4)), 0) FROM {source}) ON COLUMNS(*) INTO NAME column_name VALUE total)"


@query(o.q(o.ALL, " UNION ALL ".join(_sums_of(n, source) for n, source in _DIGEST_OF.items())))
def incremental_equals_full(spark, sf):
    """Rows and sums of all columns of all tables after a refresh that adds later periods, and one deal's late ones, to a store of the history; the SQL builds all at once."""
    known = (F.col("reporting_period") <= "199706") & ~((F.col("deal_id") == "D7") & F.col("reporting_period").between("199602", "199605"))
    rows = panel(spark, sf)
    made = Store(spark, joined(shared_dir(spark), f"refreshed-{uuid.uuid4().hex}"), most_unmatched=None)
    made.write(rows.where(known), cutover=CUTOVER)
    incremental.refresh(spark, made, rows, cutover=CUTOVER)
    return incremental.digests(made.load())


@query(o.q(o.LENS + ", seen AS (SELECT DISTINCT CAST(strptime(period, '%Y%m') AS DATE) AS d FROM panel WHERE CAST(right(period, 2) AS INTEGER) % 5 <> 0)", "SELECT strftime(CAST(m AS DATE), '%Y%m') AS missing_period FROM (SELECT unnest(generate_series((SELECT min(d) FROM seen), (SELECT max(d) FROM seen), INTERVAL 1 MONTH)) AS m) WHERE CAST(m AS DATE) NOT IN (SELECT d FROM seen)"))
def period_continuity(spark, sf):
    """Gaps of a panel that lacks its fifth and tenth months."""
    periods = panel(spark, sf).where(F.month("period_date") % 5 != 0).select("period_date").distinct()
    return control.period_gaps(periods)


_LINES = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 89 WHEN 1 THEN 90 WHEN 2 THEN 93 ELSE 88 END AS width FROM orders"


@query(f"SELECT width, count(*) AS records, count(*) FILTER (WHERE width IN (89, 90, 93)) AS accepted, count(*) FILTER (WHERE width = 93) AS with_last_field FROM ({_LINES}) GROUP BY ALL")
def ragged_ingest(spark, sf):
    """Lines of 88 to 93 fields, parsed and padded as an archive's members are."""
    from poolgauge.sources.archive import padded

    width = F.when(F.col("o_orderkey") % 4 == 0, 89).when(F.col("o_orderkey") % 4 == 1, 90).when(F.col("o_orderkey") % 4 == 2, 93).otherwise(88)
    lines = table(spark, sf, "orders").select(width.alias("width"), F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("f"), i.cast("string"))).alias("fields"))
    rows = padded(lines)
    return rows.groupBy("width").agg(F.count("*").alias("records"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("accepted") & F.col(FIELD_NAMES[-1]).isNotNull()).alias("with_last_field"))


@query(o.q(o.METRIC_CTES, "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in (e[0], o.METRIC_VERSION, *e[1:])) + ")" for e in ENTRIES) + ") AS t(metric_id, metric_version, definition, method, business_meaning, desired_direction, baseline, result_location, supported_decision, limitation)"))
def metric_catalog(spark, sf):
    return catalog(spark)


@query(o.q(o.METRIC_CTES, "SELECT 'deal_periods' AS section, count(*) AS published, count(*) AS regenerated, CAST(0 AS BIGINT) AS differing FROM deal_m UNION ALL SELECT 'pool_periods', count(*), count(*), 0 FROM pool_m UNION ALL SELECT 'portfolio_periods', count(*), count(*), 0 FROM portfolio_m UNION ALL SELECT 'metric_catalog', " + f"{len(ENTRIES)}, {len(ENTRIES)}, 0"))
def projection_parity(spark, sf):
    """The published document against one made anew from a lazy build of the panel."""
    published = _made(spark, sf, "projection", lambda folder: projection.sections(tables(spark, sf)).write.parquet(folder))
    return release.parity(spark.read.parquet(published), projection.sections(build(panel(spark, sf), cutover=CUTOVER)))


def _json(columns, order, source, section):
    body = ", ".join(f"'{c}', {'CAST(' + c + ' AS VARCHAR)' if c in projection.AMOUNTS else c}" for c in columns)
    return f"SELECT '{section}' AS section, concat_ws('|', {', '.join(order)}) AS position, CAST(json_object({body}) AS VARCHAR) AS body FROM {source}"


_PLAIN = {"portfolio_periods": ("portfolio_m", ["reporting_period"]), "pool_periods": ("pool_m", ["reporting_period", "deal_id", "reference_pool_number"])}


@query(o.q(o.METRIC_CTES, " UNION ALL ".join(_json(projection.COUNTS[n], order, source, n) for n, (source, order) in _PLAIN.items())))
def projection_json(spark, sf):
    """Counts and amounts of the published sections as JSON, in export order."""
    return projection.sections(tables(spark, sf), projection.COUNTS)


_SECTIONS = "SELECT 'portfolio_periods' AS section, '' AS deal_id FROM portfolio_m UNION ALL SELECT 'deal_periods', deal_id FROM deal_m UNION ALL SELECT 'pool_periods', deal_id FROM pool_m" + f" UNION ALL SELECT 'metric_catalog', '' FROM range({len(ENTRIES)})"


@query(o.q(o.METRIC_CTES, f"SELECT section, count(*) AS records, CAST(0 AS BIGINT) AS forbidden_records, CAST(NULL AS VARCHAR) AS first_breach FROM ({_SECTIONS}) GROUP BY section"))
def projection_published(spark, sf):
    """The projection written by its executors, a line per row, and searched again for what may not be published."""
    return projection.publish(spark, tables(spark, sf), joined(shared_dir(spark), f"projection-{uuid.uuid4().hex}"))


@query(o.q(o.METRIC_CTES, f"SELECT section, count(*) AS records, count(*) FILTER (WHERE deal_id = 'D3') AS forbidden_records, CASE WHEN bool_or(deal_id = 'D3') THEN 'deal_id=' END AS first_breach FROM ({_SECTIONS}) GROUP BY section"))
def projection_breaches(spark, sf):
    """The boundary check over sections in which one deal is named by its folder."""
    named = F.regexp_replace("body", '"deal_id":"D3"', '"deal_id":"deal_id=D3"')
    return projection.breaches(projection.sections(tables(spark, sf)).withColumn("body", named))


@query(o.q(o.METRIC_CTES, "SELECT d.deal_id, d.reporting_period, d.d60_plus_rate, p.d60_plus_rate AS portfolio_rate, d.eligible_active_loans FROM deal_m d JOIN portfolio_m p USING (reporting_period) WHERE d.reporting_period BETWEEN '199701' AND '199712'"))
def sql_metrics(spark, sf):
    """A text with named parameters over the metric tables of the store's current version."""
    text = "SELECT d.deal_id, d.reporting_period, d.d60_plus_rate, p.d60_plus_rate AS portfolio_rate, d.eligible_active_loans FROM deal d JOIN portfolio p USING (reporting_period) WHERE d.reporting_period BETWEEN :first AND :last"
    return Surface(spark, store(spark, sf).root).ask(text, first="199701", last="199712")


@query(o.q(o.TYPED, "SELECT performance_state, count(*) AS records, CAST(sum(current_upb) AS DECIMAL(30,2)) AS upb FROM typed WHERE deal_id = 'D5' AND reporting_period = '199807' GROUP BY ALL"))
def sql_loans(spark, sf):
    """A text over the typed rows of the stored foundation; its filter prunes folders. The text names no metric table, so the surface has none."""
    text = "SELECT performance_state, count(*) AS records, CAST(sum(current_upb) AS DECIMAL(30,2)) AS upb FROM loans WHERE deal_id = :deal AND reporting_period = :period GROUP BY performance_state"
    return Surface(spark, None, foundation=stored_foundation(spark, sf).root).ask(text, deal="2022-D5", period="199807")


@query(o.q(o.ALL, f"""SELECT CASE WHEN abs(round(sum(rate_effect_bps), 6)) >= abs(round(sum(mix_effect_bps), 6)) THEN 'rate_led_change' ELSE 'mix_led_change' END AS finding, CAST(NULL AS VARCHAR) AS deal_id, round(sum(rate_effect_bps), 6) AS figure FROM effects WHERE reporting_period = {LATEST}
  UNION ALL SELECT 'largest_contributor', arg_max(x.deal_id, (x.total_contribution_bps, x.deal_id)) FILTER (WHERE x.total_contribution_bps IS NOT NULL), max(x.total_contribution_bps) FROM effects x JOIN deal_m d USING (deal_id, reporting_period) WHERE reporting_period = {LATEST}
  UNION ALL SELECT 'largest_rate_increase', arg_max(d.deal_id, (d.d60_change_1m_bps, d.deal_id)) FILTER (WHERE d.d60_change_1m_bps IS NOT NULL), max(d.d60_change_1m_bps) FROM effects x JOIN deal_m d USING (deal_id, reporting_period) WHERE reporting_period = {LATEST}
  UNION ALL SELECT 'highest_escalation', arg_max(deal_id, (d30_to_d60_rate_upb, deal_id)) FILTER (WHERE d30_to_d60_rate_upb IS NOT NULL), max(d30_to_d60_rate_upb) FROM flow WHERE reporting_period = {LATEST}"""))
def findings(spark, sf):
    return endpoints.findings(tables(spark, sf))


def _case(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'Not reported' " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in LABELS[c].items()) + f" ELSE {c} END"


_CODED = ("loan_purpose", "occupancy_status", "modification_flag", "borrower_assistance_plan", "payment_deferral_flag", "zero_balance_code")


@query(o.q(o.TYPED, "SELECT " + ", ".join(f"{_case(c)} AS {c}" for c in _CODED) + ", count(*) AS records FROM typed GROUP BY ALL"))
def code_labels(spark, sf):
    rows = panel(spark, sf).select(*[label(c).alias(c) for c in _CODED])
    return rows.groupBy(*_CODED).agg(F.count("*").alias("records"))


@query(o.q(o.LENS, """SELECT CASE WHEN s IN ('00') THEN 'Current' WHEN s IN ('01', '02') THEN 'D' || 30 * CAST(s AS INTEGER) WHEN s = 'RA' THEN 'REO' WHEN try_cast(s AS INTEGER) > 2 THEN 'D90+' WHEN s <> '' THEN s
  WHEN zero_balance_code <> '' THEN 'Zero balance ' || zero_balance_code ELSE 'Unavailable' END AS record_status, count(*) AS records
  FROM (SELECT zero_balance_code, CASE WHEN zero_balance_code IS NULL OR CAST(loan_identifier AS BIGINT) % 3 <> 0 THEN current_loan_delinquency_status END AS s FROM panel) GROUP BY ALL"""))
def record_statuses(spark, sf):
    """Records by their status in words; a third of those that left are read without a status."""
    shown = F.when(F.col("zero_balance_code").isNull() | (F.col("loan_identifier").cast("long") % 3 != 0), F.col("current_loan_delinquency_status"))
    rows = foundation(spark, sf).select(record_status(shown, F.col("zero_balance_code")).alias("record_status"))
    return rows.groupBy("record_status").agg(F.count("*").alias("records"))


@query(baseline.RATES_SQL)
def baseline_rates(spark, sf):
    return baseline.rates(baseline.fixture(spark))


@query(baseline.GATES_SQL)
def baseline_gates(spark, sf):
    return baseline.gate_counts(baseline.fixture(spark))


_DAILY = """days AS (SELECT 'D' || (user_id % 10) AS deal_id, 'D' || (user_id % 10) || '-P' || (user_id % 3) AS pool, user_id, CAST(ts AS DATE) AS d, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DECIMAL(20,2)) AS upb,
  max(CASE event_type WHEN 'view' THEN '00' WHEN 'click' THEN '01' WHEN 'purchase' THEN '02' WHEN 'error' THEN '03' ELSE 'RA' END) AS s FROM events GROUP BY ALL)"""


@query(o.q(_DAILY + ", deal_days AS (SELECT DISTINCT deal_id, d FROM days)", """SELECT a.deal_id, strftime(x.d, '%Y%m%d') AS reporting_period, count(*) AS prior_records, count(b.user_id) AS matched_records, CAST(coalesce(sum(a.upb) FILTER (WHERE b.user_id IS NOT NULL), 0) AS DECIMAL(24,2)) AS matched_prior_upb
  FROM days a JOIN deal_days x ON x.deal_id = a.deal_id AND x.d = a.d + 1 LEFT JOIN days b ON b.deal_id = a.deal_id AND b.user_id = a.user_id AND b.d = a.d + 1 GROUP BY ALL"""))
def daily_flow(spark, sf):
    rows = typed(lens.daily(table(spark, sf, "events")), step="day")
    return flow.flow_metrics(rows, step="day", cutover=CUTOVER).select("deal_id", "reporting_period", "prior_records", "matched_records", "matched_prior_upb")
