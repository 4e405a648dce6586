"""Every registered query against its SQL, or else its plain twin, on the smallest tables."""

import math

import pytest

from lexiloom import plans
from tests.twins import TWINS

DATA = "/root/testdata/sf0.001"


def rows(values):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(clean, r)) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = rows(df.select(columns).collect())
    sql = plans.oracle_sql().get(name)
    if sql is None:
        source, twin = TWINS[name]
        want = twin([r.asDict() for r in spark.read.parquet(f"{DATA}/{source}.parquet").collect()])
        assert want["columns"] == columns
        assert got == rows(want["rows"])
        return
    want = duck.sql(f"select {', '.join(columns)} from ({sql})")
    assert sorted(want.columns) == columns
    assert got == rows(want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.queries()) <= set(entry.queries())
