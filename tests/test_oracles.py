"""Every query with SQL equals DuckDB on the smallest tables; the rest give rows."""

from __future__ import annotations

import pytest

from evidencelake.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"
#: May rightly be empty on the smallest tables.
MAY_BE_EMPTY = {"search_papers_prefix", "hash_dedupe", "semi_join_uploads", "constraint_predicate", "align_entities"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, ORACLES[name], duck, name in MAY_BE_EMPTY)
    else:
        assert name in MAY_BE_EMPTY or df.limit(1).count() == 1
