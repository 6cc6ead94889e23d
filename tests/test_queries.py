"""Every query of the engine against its SQL."""

import pytest
from helpers import duck_rows, spark_rows

from tessera import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_agrees_with_sql(spark, duck, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(duck, queries.ORACLES[name])


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == queries.ORACLES.keys()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["n_name", "order_count", "revenue"]
    assert e.oracle_sql().keys() <= e.queries().keys()


@pytest.mark.parametrize("name", ["nulls_first_descending_all", "nulls_last_ascending_all"])
def test_null_order_shows_all_rows(spark, sf_dir, name):
    found = [r.c_mktsegment for r in queries.QUERIES[name](spark, sf_dir).collect()]
    assert len(found) == spark.read.parquet(f"{sf_dir}/customer.parquet").count() and None in found
    known = [x for x in found if x is not None]
    assert known == sorted(known, reverse="descending" in name) and len(set(known)) > 1
    assert found == ([None] * (len(found) - len(known)) + known if "first" in name else known + [None] * (len(found) - len(known)))
