"""Queries with SQL against DuckDB, on the whole tables."""

import pytest

from cohortspan.llm.queries import ORACLES, QUERIES
from tests.conftest import TESTDATA, duck
from tests.test_oracles import same


@pytest.mark.parametrize("name", list(ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_matches_duckdb(spark, name, size):
    folder = f"{TESTDATA}/{size}"
    assert same(QUERIES[name](spark, folder), duck(folder).sql(ORACLES[name])) > 0


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
