"""Every query against its SQL, run by DuckDB on the same tables."""

import decimal
import functools

import duckdb
import pytest

import __spark_entry__ as entry
from lintmill.catalog import queries
from tests.conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_runs():
    """Queries here share one assessment of each kind."""
    kept = {name: getattr(queries, name) for name in ("_run", "_python_run", "_notebook_run")}
    for name, fn in kept.items():
        setattr(queries, name, functools.cache(fn))
    yield
    for name, fn in kept.items():
        setattr(queries, name, fn)


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.9g}"
    return "NULL" if value is None else str(value)


def table(columns, found):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(plain(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(entry.ORACLE))
def test_same_as_sql(spark, duck, name):
    cursor = duck.execute(entry.oracle_sql()[name])
    expected = table([d[0] for d in cursor.description], cursor.fetchall())
    df = entry.queries()[name](spark, SF)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql(spark):
    missing = set(entry.QUERIES) - set(entry.ORACLE)
    assert missing == set()
    assert set(entry.ORACLE) <= set(entry.QUERIES)
    parsed = entry.queries()["validations_parsed"](spark, SF)
    static = entry.queries()["validations"](spark, SF)
    # Parsing can only add issues, and only to the syntax rows.
    both = parsed.withColumnRenamed("issues_found", "n").join(static, ["path", "validation_type"])
    assert both.filter("n < issues_found or (validation_type <> 'syntax' and n <> issues_found)").count() == 0
    assert both.filter("validation_type = 'syntax' and n > issues_found").count() > 0
    assert entry.queries()["syntax_parse"](spark, SF).filter("not parses").count() > 0
