"""Every registered query against its oracle."""

import pytest

from brindle import catalogue

ORACLE = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_oracle(spark, duck, same, sf_dir, name):
    same(catalogue.queries()[name](spark, sf_dir), duck.sql(ORACLE[name]))


def test_order_is_kept(spark, sf_dir):
    rows = [r[0] for r in catalogue.queries()["order_hidden"](spark, sf_dir).collect()]
    keys = {r["n_name"]: r["n_nationkey"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    assert [keys[r] for r in rows] == sorted(keys.values())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
