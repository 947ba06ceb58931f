"""Every registered query of the library's own operators, side by side with its SQL."""

import duckdb
import pytest

from tissuemill import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(v + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = df.select(columns).collect()
    assert rows
    if name in SQL:
        cursor = con.execute(SQL[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert plain(tuple(r) for r in rows) == plain(tuple(r[i] for i in order) for r in cursor.fetchall())
