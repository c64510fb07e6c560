import pytest
from oracle_compare import differing

from poolgauge.queries import QUERIES, SQL

# the ranked lists share one plan; one of each family runs here, the driver compares them all
SKIP = {n for n in QUERIES if n.startswith(("watchlist_", "loan_page_public_"))} - {"watchlist_rate_effect_bps", "loan_page_public_d30"}


@pytest.mark.parametrize("name", sorted(set(SQL) - SKIP))
def test_query_equals_its_sql(spark, duck, name):
    assert differing(spark, duck, QUERIES[name], SQL[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
