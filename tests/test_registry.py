"""Every registered query against its SQL on the smallest tables, and that each has rows."""

import duckdb
import pytest

from redpen.plans import joins, more, review, streams  # noqa: F401
from redpen.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    return round(v, 9) if isinstance(v, float) else v


def _compared(spark, folder, name):
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = _duck(folder).execute(SQL[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols
    assert got == want
    return got


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, name):
    """On the smallest tables; a query without rows there, on the next ones."""
    assert _compared(spark, data, name) or _compared(spark, data.replace("sf0.001", "sf0.01"), name)


def test_entry(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 10
    assert set(e.oracle_sql()) <= set(e.queries())
