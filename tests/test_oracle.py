"""Every registered query against its DuckDB twin at sf0.001, and the
driver entry point."""

import pytest

from conftest import SF001
from tessera.compare import compare, duck_connect
from tessera.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF001)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, con, name):
    res = compare(spark, SF001, [name], con=con)[name]
    assert res.get("cols_match") and res.get("values_match"), res


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["customer_id", "total_accounts", "total_debit"]


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
                 "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def _duck_type(t: str) -> str:
    import re
    m = re.match(r"decimal\((\d+),(\d+)\)", t)
    return f"DECIMAL({m[1]},{m[2]})" if m else SPARK_TO_DUCK.get(t, t)


@pytest.mark.parametrize("name", list(QUERIES))
def test_types_match_oracle(spark, con, name):
    spark_types = {c: _duck_type(t) for c, t in QUERIES[name](spark, SF001).dtypes}
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    assert spark_types == duck_types
