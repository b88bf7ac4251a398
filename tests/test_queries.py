"""Every query of the library's own operators against its SQL."""

import pytest

import __spark_entry__
from chainlog.plans import catalogue

from .compare import same_rows


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_matches_sql(spark, sf_dir, name):
    same_rows(spark, sf_dir, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry_gives_rows(spark, sf_dir):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["ocel:eid", "ocel:activity", "ocel:timestamp", "ocel:oid", "ocel:type", "ocel:qualifier"]
    assert df.limit(1).count() == 1
