"""One local Spark session for all tests, and DuckDB views of the small test tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with a DuckDB relation: columns by name, rows in any order."""

    def plain(value):
        return "nothing" if value is None else f"{value:.9g}" if isinstance(value, float) else str(value)

    def compare(rows, relation):
        names = sorted(rows.columns)
        assert names == sorted(relation.columns)
        place = [relation.columns.index(n) for n in names]
        ours = sorted([plain(r[rows.columns.index(n)]) for n in names] for r in rows.collect())
        theirs = sorted([plain(r[k]) for k in place] for r in relation.fetchall())
        assert ours == theirs

    return compare
