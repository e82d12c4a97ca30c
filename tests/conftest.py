import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("scratch")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def duck(sql: str, sf_dir: str):
    """Rows of a query in DuckDB over the same tables: (column names, rows)."""
    import duckdb

    with duckdb.connect() as c:
        for f in Path(sf_dir).glob("*.parquet"):
            c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        r = c.sql(sql)
        return r.columns, r.fetchall()


def compare(df, sql: str, sf_dir: str) -> None:
    """Same columns and the same rows, in any order."""
    columns, want = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    key = lambda r: [(v is None, str(v)) for v in r]
    have = sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
    want = sorted((tuple(r[i] for i in at) for r in want), key=key)
    assert len(have) == len(want)
    wrong = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    assert not wrong, (names, len(wrong), wrong[:3])
