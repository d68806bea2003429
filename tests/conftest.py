import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def normal(frame):
    """Rows of a pandas frame in a form that two engines share."""
    import pandas as pd

    cols = sorted(frame.columns)

    def value(v):
        if hasattr(v, "tolist") and hasattr(v, "__len__"):
            return tuple(v.tolist())
        if isinstance(v, list):
            return tuple(v)
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, pd.Timestamp):
            return str(v)
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    return cols, sorted(repr(tuple(map(value, r))) for r in frame[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con
