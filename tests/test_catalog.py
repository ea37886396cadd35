"""Every registered query with SQL gives the rows that DuckDB gives."""

import pandas as pd
import pytest

from vicinal.plans import catalog


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else x for x in row) for row in df.itertuples(index=False, name=None)), key=str)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, duck):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2500
    assert set(e.oracle_sql()) <= set(e.queries())


def test_partial_top_k_stands_below_the_exchange(spark, sf):
    plan = catalog.QUERIES["knn_expr"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_row_ranges_reach_the_scan(spark, sf):
    from vicinal.sources import points as P

    plan = P.rows_between(catalog.embeddings(spark, sf), 50, 150)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,50)" in plan and "LessThan(vec_id,150)" in plan
