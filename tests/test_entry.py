import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from stemma.plans import claims

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, them):
    plain = lambda v: None if v is None else bool(v) if isinstance(v, bool) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in them)


@pytest.mark.parametrize("name", sorted(claims.SQL))
def test_sql_twin(spark, duck, name):
    df = claims.QUERIES[name](spark, SMALL)
    got = duck.execute(claims.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(claims.QUERIES) - set(claims.SQL)))
def test_without_sql(spark, name):
    assert claims.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    top = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{top}/stemma/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"stemma\.llm|from \.llm", open(path).read()), path
