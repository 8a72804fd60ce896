"""Every registered query against its DuckDB statement, on the whole test tables."""

import pytest

import __spark_entry__ as registry
from tests.conftest import TESTDATA, duck

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


def same(spark_df, relation):
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns)
    kinds = dict(spark_df.dtypes)
    wanted = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: SPARK_TO_DUCK[kinds[c]] for c in columns} == wanted
    key = repr
    found = sorted((tuple(r) for r in spark_df.select(*columns).collect()), key=key)
    expected = sorted(relation.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=key)
    assert found == expected
    return len(found)


# The operators on documents have tests of their own.
NAMES = [name for name in registry.queries() if name != "pipeline" and not name.startswith("op")]


def test_every_query_has_a_statement():
    assert set(NAMES) <= registry.oracle_sql().keys() <= registry.queries().keys()


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, name):
    folder = f"{TESTDATA}/sf0.01"
    rows = same(registry.queries()[name](spark, folder), duck(folder).sql(registry.oracle_sql()[name]))
    assert rows > 0


@pytest.mark.parametrize("name", [n for n in NAMES if n[0] == "r" and n[1].isdigit()])
def test_reports_match_on_sparse_data(spark, name):
    # Here most cells are small enough to be suppressed.
    folder = f"{TESTDATA}/sf0.001"
    same(registry.queries()[name](spark, folder), duck(folder).sql(registry.oracle_sql()[name]))


def test_entry(spark):
    row = registry.entry(spark).collect()
    assert len(row) == 1 and row[0]["n"] == 6 and row[0]["median_days_to_diag"] == -1244
