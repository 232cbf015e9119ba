import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return f"{value + 0.0:.9g}"
    if type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    if isinstance(value, int):
        return f"{value:.9g}" if abs(value) < 10**8 else str(value)
    return str(value)


@pytest.fixture(scope="session")
def same_rows(duck):
    def check(df, sql):
        columns = sorted(df.columns)
        relation = duck.sql(sql)
        assert sorted(relation.columns) == columns
        got = sorted(tuple(map(plain, row)) for row in df.select(*columns).collect())
        want = sorted(tuple(map(plain, row)) for row in relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())
        assert got == want

    return check
