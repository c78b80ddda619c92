import pytest

import __spark_entry__
from oracle import SMALL, same
from termloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(spark, name, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SMALL).count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 100


def test_search_is_one_scan(spark):
    plan = catalog.queries()["bool_and_search"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
