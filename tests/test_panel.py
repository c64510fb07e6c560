"""Three months of six loans, worked out by hand, and the gates over them."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from poolgauge.functions import columns
from poolgauge.functions.layout import FIELD_NAMES, FOUNDATION_SCHEMA
from poolgauge.operators import attribution, components, control, flow, masking
from poolgauge.operators.typed import typed
from poolgauge.plans import endpoints, incremental, projection
from poolgauge.plans.tables import GATES, Store, build, inventory, survey

KEY = "ab" * 32


def row(deal, period, loan, upb, status, **more):
    base = dict.fromkeys(FIELD_NAMES) | {"period": period, "reference_pool_number": f"{deal}-1", "loan_identifier": loan, "current_actual_upb": str(upb), "upb_at_issuance": "100", "current_loan_delinquency_status": status, "distressed_principal_balance_flag": "N", "classic_fico": "700", "original_ltv": "80", "original_dti": "30", "occupancy_status": "P", "postal_code_3_digit": "123"}
    return ({"deal_id": deal, "source_member": "m", "source_field_count": 93} | base | more)


def loans(last="202608"):
    months = [m for m in ("202606", "202607", "202608") if m <= last]
    out = []
    for i, m in enumerate(months):
        out += [
            row("HQA1", m, "A1", 100, ("00", "01", "02")[i], **({"modification_flag": "Y", "payment_deferral_flag": "C", "borrower_assistance_plan": "F"} if i == 1 else {})),
            row("HQA1", m, "A2", 50, ("01", "00", "00")[i]),
            row("HQA1", m, "A3", (80, 0, 0)[i], "00", zero_balance_code=(None, "01", "01")[i]),
            row("HQA1", m, "A4", 20, "RA"),
            row("HQA1", m, "A5", (60, 0, 0)[i], "02", zero_balance_code=(None, "02", "02")[i], actual_loss=(None, "10", "15")[i], distressed_principal_balance_flag="9"),
            row("DNA2", m, "B1", 100, "02"),
        ]
    return out


@pytest.fixture
def foundation(spark):
    return lambda last="202608": spark.createDataFrame([tuple(r[f.name] for f in FOUNDATION_SCHEMA) for r in loans(last)], FOUNDATION_SCHEMA)


@pytest.fixture
def tables(foundation):
    return build(typed(foundation()))


def test_portfolio_of_the_last_month(tables):
    r = tables.portfolio.where("reporting_period='202608'").first()
    assert (r.reported_current_upb, r.eligible_current_upb, r.excluded_ra_upb, r.d60_plus_upb, r.d60_plus_rate) == (270, 250, 20, 200, 0.8)


def test_flow_of_the_second_month(tables):
    r = tables.flow.where("deal_id='HQA1' AND reporting_period='202607'").first()
    assert (r.current_to_d30_loans, r.cured_loans, r.voluntary_payoff_loans, r.credit_event_exit_loans, r.new_modification_loans) == (1, 1, 1, 1, 1)
    assert r.actual_loss_increment is None


def test_assistance_and_losses(tables):
    assert tables.deal.where("deal_id='HQA1' AND reporting_period='202607'").first().assistance_exposure_share == pytest.approx(2 / 3)
    r = tables.flow.where("deal_id='HQA1' AND reporting_period='202608'").first()
    assert (r.d30_to_d60_loans, r.actual_loss_increment_observations, r.actual_loss_increment) == (1, 1, Decimal("5.00"))


def test_identity_and_reconciliation(tables, foundation):
    assert control.check_identity(attribution.identity_variance(tables.decomposition, tables.portfolio))["maximum_variance_bps"] < 0.01
    found = control.reconciliation(tables.pool, control.release_aggregate(foundation()))
    assert control.check_reconciliation(control.reconciliation_summary(found), 6)["max_current_upb_variance"] == 0
    off = control.release_aggregate(foundation()).withColumn("current_upb", F.col("current_upb") + 1)
    with pytest.raises(control.GateError):
        control.check_reconciliation(control.reconciliation_summary(control.reconciliation(tables.pool, off)), 6)


def test_both_forms_of_flow_agree(foundation):
    rows = typed(foundation())
    a, b = (flow.flow_metrics(rows, by_join=j) for j in (False, True))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_algebra(tables):
    p, d, w = tables.pool_components, tables.deal_components, tables.portfolio_components
    total = lambda t: t.agg(F.sum("eligible_current_upb")).first()[0]
    assert total(p) == total(d) == total(w)
    assert tables.pool.where("d90_plus_upb > d60_plus_upb OR d60_plus_upb > d30_plus_upb OR d30_plus_upb > eligible_current_upb").isEmpty()
    assert tables.flow.where("matched_records + approved_exit_records + error_unmatched_records <> prior_records").isEmpty()
    shares = tables.layers.groupBy("deal_id", "reporting_period").agg(F.sum("upb_share").alias("s"))
    assert shares.where("abs(s - 1) > 1e-12").isEmpty()


def test_input_gates(spark, foundation):
    good = typed(foundation())
    assert control.check_inputs(control.input_gate_counts(good), 18)["records"] == 18
    for column, value in (("current_actual_upb", "-1"), ("current_actual_upb", "1,000"), ("current_loan_delinquency_status", "7"), ("distressed_principal_balance_flag", "?")):
        with pytest.raises(control.GateError):
            control.check_inputs(control.input_gate_counts(typed(foundation().withColumn(column, F.lit(value)))))


def test_statuses_and_sentinels(spark):
    raw = [row("D", "202601", str(i), 1, s, classic_fico=f, original_ltv=v) for i, (s, f, v) in enumerate([("01\n", "299", "999"), (None, "9999", "998"), ("99", "700.5", "0.5"), ("RA", "", "80.25")])]
    out = typed(spark.createDataFrame([tuple(r[f.name] for f in FOUNDATION_SCHEMA) for r in raw], FOUNDATION_SCHEMA)).orderBy("loan_identifier").collect()
    assert [r.delinquency_months for r in out] == [None, None, 99, None]
    assert [r.performance_state for r in out] == ["UNKNOWN", "UNKNOWN", "D90_PLUS", "REO"]
    assert [r.classic_fico_value for r in out] == [None, None, 701, None]
    assert [r.original_ltv_value for r in out] == [None, Decimal("998.0000"), None, Decimal("80.2500")]


def test_masking(foundation):
    rows = foundation()
    public = masking.masked(rows, KEY)
    assert masking.check_masking(rows, public)["invalid_loan_tokens"] == 0
    names = {(r.loan_identifier) for r in public.where("period='202606'").collect()}
    assert names == {r.loan_identifier for r in public.where("period='202608'").collect()} and len(names) == 6
    assert masking.masked(rows.withColumn("loan_identifier", F.lit("")), KEY).first().loan_identifier is None
    with pytest.raises(control.GateError):
        masking.masked(rows, "ab" * 31)
    with pytest.raises(control.GateError):
        masking.check_masking(rows, public.withColumn("loan_identifier", F.lit("A1")))


def test_pages(foundation):
    rows = typed(foundation())
    total, page = endpoints.loan_page(rows, "202608", "HQA1", limit=2)
    _, rest = endpoints.loan_page(rows, "202608", "HQA1", limit=100, offset=2, reveal=True)
    assert total.first().total == 5 and page.count() == 2 and rest.count() == 3
    assert all(r.loan_identifier.startswith("restricted-") for r in page.collect())
    assert endpoints.public_page(foundation().where("period='202608'"), "d60")[0].first().total == 3
    for bad in (dict(limit=0), dict(limit=101), dict(offset=-1)):
        with pytest.raises(endpoints.RequestError):
            endpoints.loan_page(rows, "202608", "HQA1", **bad)
    for args in (("2026", "HQA1"), ("202608", "x y"), ("202608", "HQA1", "late")):
        with pytest.raises(endpoints.RequestError):
            endpoints.loan_page(rows, *args)
    with pytest.raises(endpoints.RequestError):
        endpoints.public_page(rows, limit=51)


def test_views(tables):
    assert endpoints.watchlist(tables, "202608").count() == 2
    view = endpoints.deal_view(tables, "HQA1", "202608")
    assert view["current"].count() == 1 and view["series"].count() == 3 and view["pools"].count() == 1
    assert endpoints.bootstrap(tables)["catalog"].count() == 20
    assert endpoints.evidence_package(tables, "HQA1", "202608")["identity"].count() == 1


def test_projection(tables):
    doc = projection.document(tables)
    assert doc["controls"] == {"portfolio_periods": 3, "deal_periods": 6, "pool_periods": 6, "metric_catalog": 19}
    with pytest.raises(control.GateError):
        projection.check_boundary({"a": [{"loan_identifier": 1}]})
    with pytest.raises(control.GateError):
        projection.check_boundary({"a": ["see s3a://bucket/foundation"]})


def test_store_refresh_and_recovery(spark, foundation, tmp_path):
    store = Store(spark, str(tmp_path))
    first = incremental.refresh(spark, store, typed(foundation("202607")))
    assert first["status"] == "pass" and store.load().portfolio.count() == 2
    assert incremental.refresh(spark, store, typed(foundation("202607")))["kind"] == "no-op"
    incremental.Journal(str(tmp_path)).start(kind="delta")
    (tmp_path / "v-orphan").mkdir()
    done = incremental.refresh(spark, store, typed(foundation()))
    assert len(done["recovered"]) == 1 and not (tmp_path / "v-orphan").exists()
    rates = [r.d60_plus_rate for r in store.load().portfolio.orderBy("reporting_period").collect()]
    assert rates == [r.d60_plus_rate for r in components.portfolio_metrics(typed(foundation())).orderBy("reporting_period").collect()]
    bad = typed(foundation()).withColumn("reporting_period", F.lit("202609")).withColumn("current_upb", F.lit(None).cast("decimal(20,2)"))
    with pytest.raises(control.GateError):
        incremental.refresh(spark, store, typed(foundation()).unionByName(bad))
    assert store.current() == done["version"]


def test_late_deals_are_taken(spark, foundation, tmp_path):
    """A deal that comes with months already covered by another is added, not dropped."""
    store = Store(spark, str(tmp_path))
    whole = foundation()
    incremental.refresh(spark, store, typed(whole.where("deal_id = 'HQA1'")), source=whole.where("deal_id = 'HQA1'"))
    late = whole.where("deal_id = 'HQA1' OR period <> '202608'")
    assert incremental.refresh(spark, store, typed(late), source=late)["kind"] == "delta"
    assert incremental.refresh(spark, store, typed(whole), source=whole)["kind"] == "delta"
    full = build(typed(whole))
    for n in ("pool", "deal", "portfolio", "flow", "layers", "decomposition"):
        a, b = getattr(store.load(), n), getattr(full, n)
        assert a.exceptAll(b.select(a.columns)).isEmpty() and b.exceptAll(a.select(b.columns)).isEmpty(), n


def test_revised_and_missing_partitions_are_refused(spark, foundation, tmp_path):
    store = Store(spark, str(tmp_path))
    whole = foundation()
    version = incremental.refresh(spark, store, typed(whole))["version"]
    revised = whole.withColumn("modification_flag", F.when(F.col("period") == "202607", "Y").otherwise(F.col("modification_flag")))
    for offer in (revised, whole.where("period <> '202607'")):
        with pytest.raises(control.GateError, match="append only"):
            incremental.refresh(spark, store, typed(offer))
    assert store.current() == version
    assert [r.status for r in incremental.Journal(str(tmp_path)).frame(spark).orderBy("started").collect()] == ["pass", "failed", "failed"]


def test_reconciliation_and_unique_loans_are_enforced(spark, foundation, tmp_path):
    whole = foundation()
    with pytest.raises(control.GateError, match="reconciliation"):
        Store(spark, str(tmp_path / "a")).write(typed(whole), source=whole.where("loan_identifier <> 'A1'"))
    with pytest.raises(control.GateError, match="unique"):
        Store(spark, str(tmp_path / "b")).write(typed(whole.unionByName(whole.where("loan_identifier = 'A1' AND period = '202606'"))))


def test_rows_without_ids_match_nothing(spark, foundation):
    rows = typed(foundation().withColumn("loan_identifier", F.when(F.col("loan_identifier") != "A2", F.col("loan_identifier"))))
    a, b = (flow.flow_metrics(rows, by_join=j) for j in (False, True))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    r = a.where("deal_id = 'HQA1' AND reporting_period = '202607'").first()
    assert (r.prior_records, r.matched_records, r.error_unmatched_records, r.new_records) == (5, 4, 1, 1)


def test_a_build_reads_the_panel_three_times(spark, foundation, tmp_path):
    """Components, flow and layers; all else comes from components."""
    foundation().write.parquet(str(tmp_path / "f"))
    t = build(typed(spark.read.parquet(str(tmp_path / "f"))))
    scans = {n: getattr(t, n)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") for n in ("pool", "deal", "portfolio", "flow", "layers", "decomposition")}
    assert scans == {"pool": 0, "deal": 0, "portfolio": 0, "flow": 1, "layers": 1, "decomposition": 0}


def test_append_only(spark):
    had = spark.createDataFrame([("D", "1", 5), ("D", "2", 6), ("D", "3", 7)], "deal_id string, reporting_period string, crc32 long")
    got = spark.createDataFrame([("D", "2", 6), ("D", "3", 8), ("D", "4", 9)], had.schema)
    assert {(r.reporting_period, r.change) for r in control.append_only_diff(had, got).collect()} == {("1", "missing"), ("3", "changed"), ("4", "new")}


def test_digests_do_not_depend_on_the_order_of_rows(spark):
    """Large balances in doubles: their sum as doubles differs in the fourth place from one order to another."""
    from types import SimpleNamespace

    from poolgauge.plans import incremental

    values = [1426748664410.87 / (i + 3) for i in range(500)]
    some = lambda order: SimpleNamespace(**{n: spark.createDataFrame([(v,) for v in order], "upb double").coalesce(1) for n in incremental.NAMES})
    one, other = (sorted(map(tuple, incremental.digests(some(o)).collect())) for o in (values, values[::-1]))
    assert one == other


def test_orders_of_one_split_are_typed_by_all_tasks(spark):
    """A small file is one split, whatever it grows to."""
    from poolgauge import queries

    rows = queries.panel(spark, "/root/testdata/sf0.001")
    assert queries.table(spark, "/root/testdata/sf0.001", "orders").coalesce(1).rdd.getNumPartitions() == 1
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_flow_reads_the_panel_once_and_drops_what_no_period_follows(foundation):
    rows = typed(foundation().where("NOT (deal_id = 'HQA1' AND period = '202607')"))
    found = flow.flow_metrics(rows)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    listed = lambda d: sorted(str(r) for r in d.collect())
    assert {r.deal_id for r in found.collect()} == {"DNA2"} and listed(found) == listed(flow.flow_metrics(rows, by_join=True).select(*found.columns))


def test_amounts_are_summed_exactly_as_whole_numbers(spark):
    """Of any size and sign, and null where nothing was reported; the sums of a row are not of decimals."""
    texts = ["999999999999999999.99", "-999999999999999999.98", "0.01", "-10000000.50", "-0.49", "9999999.99", "123456789012345.67", None, ""]
    base = lambda pool, text: row(pool, "202606", f"L{text}", text, "00") | {"current_actual_upb": text, "actual_loss": text, "reference_pool_number": pool}
    rows = [base("A", t) for t in texts] + [base("B", None)]
    made = components.pool_components(typed(spark.createDataFrame([tuple(r[f.name] for f in FOUNDATION_SCHEMA) for r in rows], FOUNDATION_SCHEMA)))
    found = {r.reference_pool_number: r for r in made.collect()}
    total = sum(Decimal(t) for t in texts if t)
    active = sum(Decimal(t) for t in texts if t and Decimal(t) > 0)
    a, b = found["A"], found["B"]
    assert (a.reported_current_upb, a.cumulative_actual_loss, a.eligible_current_upb, a.actual_loss_observations) == (total, total, active, 7)
    assert (b.reported_current_upb, b.cumulative_actual_loss, b.eligible_current_upb) == (None, 0, 0)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(actual_loss#" not in plan and "partial_sum(issuance_upb#" not in plan


def test_texts_of_digits_are_read_as_before(spark):
    """Codes and periods are digits and nothing else; whole numbers of any writing are rounded half up."""
    given = ["199812", "199813", "199800", "000101", "19981", " 19981", "+19981", "199812\n", "٣٤٥٦٧٨", "12.5", "-12.5", "007", "1e3", "\x7f12", "2147483648", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    old = F.when(F.col("t").rlike(r"^[0-9]{6}\z"), F.try_to_timestamp("t", F.lit("yyyyMM")).cast("date"))
    wholes = F.round(F.col("t").try_cast("decimal(38,10)"), 0).try_cast("int")
    assert [tuple(r) for r in df.orderBy("i").select(columns.month_start(F.col("t")), columns.whole("t")).collect()] == [tuple(r) for r in df.orderBy("i").select(old, wholes).collect()]
    assert [r[0] for r in df.orderBy("i").select(columns.digits(F.col("t"), 3)).collect()] == [7 if t == "007" else None for t in given]


def test_transition_matrix_reads_the_panel_once(foundation):
    whole = foundation()
    rows = typed(whole.unionByName(whole.where("loan_identifier = 'A2'").withColumn("loan_identifier", F.lit(None).cast("string"))))
    made = flow.transition_matrix(rows)
    by_join = flow.pairs_by_join(rows).where("is_matched").groupBy("prior_state", F.col("performance_state").alias("state")).agg(F.count("*").alias("loans"), F.sum("prior_upb").cast("decimal(24,2)").alias("prior_upb"))
    assert made.exceptAll(by_join).isEmpty() and by_join.exceptAll(made).isEmpty()
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_survey_gives_inventory_layers_and_gates_in_one_read(foundation):
    rows = typed(foundation())
    found = survey(rows)
    same = lambda a, b: a.schema.names == b.schema.names and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert same(components.layers_of_sums(found), components.risk_layers(rows))
    assert same(found.select("deal_id", "reporting_period", "records", "upb", "content"), inventory(rows))
    assert same(found.agg(*[F.sum(c).alias(c) for c in ("records", *GATES)]), control.input_gate_counts(rows))
