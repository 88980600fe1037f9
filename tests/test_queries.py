"""Every query with SQL gives DuckDB's rows; the entry query runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from skeinwork.plans import catalog, context, evaluations, indexes, journals, lookups, matches, reports, workflows, details  # noqa: F401

NAMES = sorted(catalog.oracle_sql())


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([None if r[i] is None else round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, db, name):
    got = catalog.queries()[name](spark, sf_dir)
    want = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
