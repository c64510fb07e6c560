"""Pages by cursor, the SQL surface, and publications without a collect."""

import pytest
from pyspark.sql import functions as F
from test_panel import foundation, tables  # noqa: F401

from poolgauge.operators.control import GateError
from poolgauge.operators.typed import typed
from poolgauge.plans import endpoints, pages, projection, release
from poolgauge.plans.surface import QueryError, Surface
from poolgauge.plans.tables import Store
from poolgauge.sources.foundation import Foundation


def walk(of, limit):
    """All rows, page by page, and the number of pages."""
    out, after, n = [], None, 0
    while True:
        found = of(limit, after).collect()
        out, n = out + found, n + 1
        if len(found) < limit:
            return out, n
        after = found[-1]["cursor"]


ROWS = [(a, b, i % 3) for a in (None, 1, 2) for b in (None, "x", "y") for i in range(5)]


def paged(df, limit, after=None):
    return pages.page(df, [pages.Key(F.col("a"), True), pages.Key(F.col("b"))], limit, after)


@pytest.mark.parametrize("limit", [1, 4, 5, 7, 45, 46])
def test_pages_are_disjoint_and_whole(spark, limit):
    df = spark.createDataFrame(ROWS, "a int, b string, c int").repartition(3)
    got, n = walk(lambda k, after: paged(df, k, after), limit)
    assert n == len(ROWS) // limit + 1
    assert sorted(map(str, [r[:3] for r in got])) == sorted(map(str, ROWS))
    rank = [(r.a is None, -(r.a or 0), r.b is None, r.b or "") for r in got]
    assert rank == sorted(rank)


def test_page_of_an_empty_table_and_wrong_cursors(spark):
    df = spark.createDataFrame([], "a int, b string, c int")
    assert paged(df, 3).collect() == [] and pages.last_cursor(paged(df, 3), 3) is None
    for bad in ("", "[]", "{}", '{"keys": ["1"], "shown": 1}', '{"keys": ["1", "x", "5"], "shown": 0}', '{"keys": ["1", "x", 5], "shown": 1}', '{"keys": ["1", "x", "5"], "shown": true}'):
        with pytest.raises(pages.CursorError):
            paged(df, 3, bad)


def test_pages_by_cursor_are_those_by_offset(foundation):  # noqa: F811
    rows = typed(foundation())
    for limit in (1, 2, 5):
        by_offset = [r for at in range(0, 5, limit) for r in endpoints.loan_page(rows, "202608", "HQA1", limit=limit, offset=at)[1].collect()]
        got, _ = walk(lambda k, after: endpoints.loan_page_after(rows, "202608", "HQA1", limit=k, after=after), limit)
        assert [r[:-1] for r in got] == [tuple(r) for r in by_offset]
    assert all(r.loan_identifier.startswith("restricted-") for r in got)
    public = foundation().where("period='202608'")
    got, _ = walk(lambda k, after: endpoints.public_page_after(public, limit=k, after=after), 2)
    assert [r[:-1] for r in got] == [tuple(r) for r in endpoints.public_page(public)[1].collect()]
    with pytest.raises(endpoints.RequestError):
        endpoints.loan_page_after(rows, "202608", "HQA1", limit=101)


def test_two_readers_of_two_versions(spark, foundation, tmp_path):  # noqa: F811
    made = Store(spark, str(tmp_path / "store"), most_unmatched=None)
    old = made.write(typed(foundation("202607")))["version"]
    new = made.write(typed(foundation()))["version"]
    a, b = Surface(spark, made.root, old), Surface(spark, made.root)
    assert (a.version, b.version) == (old, new)
    text = "WITH m AS (SELECT max(reporting_period) AS p FROM portfolio WHERE reporting_period >= :first) SELECT p FROM m"
    assert [s.ask(text, first="202601").first().p for s in (a, b, a)] == ["202607", "202608", "202607"]
    assert b.ask("SELECT * FROM deal WHERE deal_id = :deal", deal="x' OR '1' = '1").isEmpty()
    assert not spark.catalog.tableExists("portfolio")
    assert b.session.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    for bad in ("DROP VIEW deal", "SELECT", f"SELECT * FROM parquet.`{made.root}`", "SELECT * FROM deal WHERE deal_id IN (SELECT a FROM other)", "SELECT (SELECT max(x) FROM elsewhere) FROM deal", "SELECT * FROM loans", "WITH deal2 AS (SELECT * FROM hidden) SELECT * FROM deal2", "SELECT * FROM range(3)"):
        with pytest.raises(QueryError):
            b.ask(bad)


def test_publication_is_checked_on_executors(spark, tables, tmp_path):  # noqa: F811
    found = {r.section: r for r in projection.publish(spark, tables, str(tmp_path / "p")).collect()}
    assert {n: r.records for n, r in found.items()} == {"portfolio_periods": 3, "deal_periods": 6, "pool_periods": 6, "metric_catalog": 19}
    assert all(r.forbidden_records == 0 and r.first_breach is None for r in found.values())
    assert projection.read(spark, str(tmp_path / "p")).exceptAll(projection.sections(tables).select("position", "body", "section")).isEmpty()
    with pytest.raises(GateError, match="already"):
        projection.publish(spark, tables, str(tmp_path / "p"))
    tables.pool = tables.pool.withColumn("reference_pool_number", F.lit("s3a://x"))
    with pytest.raises(GateError, match="s3a"):
        projection.publish(spark, tables, str(tmp_path / "q"))
    assert [p.name for p in tmp_path.iterdir()] == ["p"]


def test_forbidden_names_at_any_depth(spark):
    df = spark.createDataFrame([], "a struct<b: array<struct<loan_identifier: string>>>, m map<string, struct<seller_name: int>>, ok string")
    assert projection.forbidden_names(df.schema) == ["$.a.b[].loan_identifier", "$.m{}.seller_name"]
    bodies = spark.createDataFrame([("s", '{"a":{"b":{"servicer_name":1}}}'), ("s", '{"t":"of \\"servicer_name\\": none"}'), ("s", '{"t":"/foundation"}'), ("t", "{}"), ("t", None)], "section string, body string")
    assert sorted(map(tuple, projection.breaches(bodies).collect())) == [("s", 3, 2, "/foundation"), ("t", 2, 0, None)]


def test_release_follows_late_deals_of_known_periods(spark, foundation, tmp_path):  # noqa: F811
    folder = str(tmp_path / "release")
    part = foundation().where("deal_id = 'HQA1'")
    assert release.rebuilt_if_behind(spark, folder, part, "synthetic-fixture").count() == 3
    assert release.rebuilt_if_behind(spark, folder, foundation(), "synthetic-fixture").count() == 6
    fewer = foundation().where("loan_identifier <> 'A4'")
    assert release.rebuilt_if_behind(spark, folder, fewer, "synthetic-fixture").agg(F.sum("records_aggregated")).first()[0] == fewer.count()


def test_a_surface_of_a_foundation_needs_no_store(spark, foundation, tmp_path):  # noqa: F811
    made = Foundation(spark, str(tmp_path / "f"))
    made.append(foundation())
    loans = Surface(spark, None, foundation=made.root)
    assert loans.views == ("loans",) and loans.ask("SELECT count(*) AS n FROM loans WHERE reporting_period = :p", p="202607").first().n == foundation().where("period = '202607'").count()
    with pytest.raises(QueryError):
        loans.ask("SELECT * FROM deal")
