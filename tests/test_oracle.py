"""Every query of the analytics catalogue against its DuckDB formulation (driver check)."""

import os

import pytest

import __spark_entry__ as E
from crashlens import catalog
from tests.oracle_check import compare, duck

SF = os.environ.get("CRASHLENS_ORACLE_SF", "/root/testdata/sf0.01")
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_oracle():
    missing = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))
    assert missing == []


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()
    res = compare(got, want)
    assert res["ok"], res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["app_name", "app_version", "crashes", "affected_users",
                          "crashes_per_user"]
    assert df.count() > 0


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "TimestampNTZType()": "TIMESTAMP",
                 "DateType()": "DATE", "BooleanType()": "BOOLEAN"}


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("stream")])
def test_query_types_match_oracle(spark, con, name):
    sdf = catalog.queries()[name](spark, SF)
    got = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in sdf.schema.fields}
    rel = con.sql(catalog.oracle_sql()[name])
    want = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert got == want
