"""Every registered query against its comparison SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(rows):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(one(x) for x in row) for row in rows)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, folder, duck, name):
    df = entry_module.queries()[name](spark, folder)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    wanted = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert canonical(rows) == canonical(wanted)


def test_entry(spark, folder):
    assert entry_module.entry(spark).count() == 5
