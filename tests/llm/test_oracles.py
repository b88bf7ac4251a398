"""Queries of the training-data operators against their SQL, and on tables without rows."""

import pytest

from chainlog.llm import oracles, queries

from ..compare import same_rows


@pytest.mark.parametrize("name", oracles.ORACLES)
def test_query_matches_sql(spark, sf_dir, name):
    same_rows(spark, sf_dir, queries.QUERIES[name], oracles.ORACLES[name])


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    tables = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "pages": "page_id long, url string, html string",
        "conversations": "conv_id long, turn long, role string, text string",
    }
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables_give_empty_results(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0
