import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from siftwell.sources.fixtures import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def said(value):
    if value is None or (isinstance(value, float) and value != value) or str(value) in ("<NA>", "NaT"):
        return "None"
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def rows_of(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(str([said(v) for v in row]) for row in pdf[columns].astype(object).values.tolist())
