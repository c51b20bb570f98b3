"""Every query with SQL gives what the SQL gives; every query runs on the small tables and on empty ones."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("FINDLAKE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

import __spark_entry__ as entry  # noqa: E402

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(f"{folder}/{os.path.basename(path)}")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        cur = duck.execute(SQL[name])
        assert canonical(df.columns, rows) == canonical([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", QUERIES)
def test_query_on_empty_tables(spark, empty_dir, name):
    QUERIES[name](spark, empty_dir).collect()


def test_entry_and_names():
    assert set(SQL) <= set(QUERIES)
    assert not [n for n in QUERIES if n.startswith("p") and n[1:2].isdigit() and "_" not in n]
