from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql.types import StructField, StructType

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from outletscope.sources.domain import load_domain  # noqa: E402
from outletscope.sources.schemas import SCHEMAS  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    def connect(directory: str):
        connection = duckdb.connect()
        for file in Path(directory).glob("*.parquet"):
            connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        return connection

    return connect


@pytest.fixture
def make_domain(spark):
    """A domain out of rows of a few tables; the others are empty."""

    def nullable(table: str) -> StructType:
        return StructType([StructField(f.name, f.dataType, True) for f in SCHEMAS[table].fields])

    def make(**tables: list[tuple]):
        return load_domain(lambda name: spark.createDataFrame(tables.get(name, []), nullable(name)))

    return make
