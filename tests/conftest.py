import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows_of(frame) -> list:
    """Rows as sorted tuples of plain values, columns by name."""
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="session")
def same():
    def check(df, con, sql):
        expected = con.sql(sql).df()
        got = df.toPandas()
        assert sorted(got.columns) == sorted(expected.columns)
        number = lambda rows: [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows]
        a, b = number(rows_of(got)), number(rows_of(expected))
        assert sorted(a, key=str) == sorted(b, key=str)

    return check
