"""Queries on training data against their SQL, run by DuckDB on the same tables."""

import pytest

from lintmill.llm import oracles, queries
from tests.conftest import SF
from tests.test_oracle import duck, table  # noqa: F401


@pytest.mark.parametrize("name", sorted(oracles.ORACLE))
def test_same_as_sql(spark, duck, name):  # noqa: F811
    cursor = duck.execute(oracles.ORACLE[name])
    expected = table([d[0] for d in cursor.description], cursor.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == expected
