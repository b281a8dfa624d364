"""The llm queries that SQL can express equal DuckDB; the rest are held against plain versions in this folder."""

from __future__ import annotations

import pytest

from evidencelake.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], connect(SF))
