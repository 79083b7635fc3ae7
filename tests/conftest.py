import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tillweave.session import get_session

    session = get_session(
        "tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    """A small copy of the tables: four brands, the first 1,250 days."""
    import duckdb

    if not os.path.isdir(SOURCE):
        pytest.skip("sample tables are not here")
    folder = tempfile.mkdtemp(prefix="tillweave-tables-")
    con = duckdb.connect()
    names = sorted(f[: -len(".parquet")] for f in os.listdir(SOURCE) if f.endswith(".parquet"))
    for name in names:
        query = f"SELECT * FROM '{SOURCE}/{name}.parquet'"
        if name == "lineitem":
            query += f""" WHERE l_shipdate < DATE '1998-06-01'
                AND l_partkey IN (SELECT p_partkey FROM '{SOURCE}/part.parquet' WHERE p_brand IN ('Brand#1', 'Brand#4', 'Brand#7', 'Brand#12'))"""
        con.execute(f"COPY ({query}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder
