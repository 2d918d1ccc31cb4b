"""Every registered query that has SQL gives what DuckDB gives over the smallest tables; the others give rows."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings sources records translations gradings record_vectors removals eval_cases doc_levels".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(value):
    return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    if name not in SQL:
        assert mine or name.endswith(("gate", "differ"))
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["tab", "load_month", "row_no", "orphan_state"]


def test_no_reader_needs_the_llm_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['quotewright.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith(('p1_', 'p2_', 'p4_')) for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
