"""Every registered query with SQL gives the same rows as its SQL; the others give rows."""

import pytest

from tests.oracle import compare, duck

from quillstone.plans import catalogue


@pytest.fixture(scope="session")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        compare(df, catalogue.ORACLES[name], con)
    else:
        assert df.count() > 0
