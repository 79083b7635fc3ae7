"""Every registered query against its SQL twin on the small tables."""

import oracle
import pytest

from tillweave.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data_dir):
    return oracle.connect(data_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data_dir, con, name):
    assert oracle.compare(QUERIES[name](spark, data_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, data_dir, name):
    df = QUERIES[name](spark, data_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_twins_have_queries():
    assert set(ORACLES) <= set(QUERIES)
