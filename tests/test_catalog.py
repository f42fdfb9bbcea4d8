"""Every query against its SQL on the smallest tables; the others must give rows."""

import pytest

import __spark_entry__ as entry
import check

@pytest.fixture(scope="module")
def db(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", list(entry.catalog.QUERIES))
def test_query(spark, db, sf_dir, name):
    assert check.compare(spark, db, name, sf_dir) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 40
