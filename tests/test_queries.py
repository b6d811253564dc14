"""Every query that has SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(spark_rows, duck_rows):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted(map(tuple, spark_rows), key=key) == sorted(map(tuple, duck_rows), key=key)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert cols == sorted(rel.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert same(df.select(*cols).collect(), duck.execute(f"SELECT {quoted} FROM ({catalog.ORACLE_SQL[name]})").fetchall())


def test_window_form_has_one_exchange_and_no_python(spark):
    plan = catalog.QUERIES["dwt53_signal"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_three_levels_run_six_exchanges(spark):
    for name, most in (("dwt53_multilevel", 6), ("dwt53_multilevel_identity", 12)):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most and "Union" not in plan


def test_empty_batches(spark, tmp_path):
    """Tables without rows give results without rows."""
    for name in ("part", "orders", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("tlm_explode", "siz_write", "siz_parse", "header_validate", "metadata_scan", "t1_identity", "dwt53_multilevel"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1000
